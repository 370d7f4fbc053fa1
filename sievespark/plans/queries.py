"""Queries over the given tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.formats import FORMATS
from ..functions.national import IDENTIFIERS
from ..functions.rules import DEFAULT, PROVIDERS, provider_rule, provider_tokens
from ..functions.samples import sample, with_sample
from ..operators import spans as P
from ..operators.detect import detect, detect_sql
from ..operators.national import detect_national, national_sql
from ..operators.ranks import row_numbers
from ..sources import json_leaves as J
from ..streaming.registry import redact_batch, redact_stream, run_available

KEY = b"an example key, not a secret"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The findings of the default rules, for the queries' SQL.
FOUND = f"WITH f AS ({detect_sql(DEFAULT)})\n"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(docs(spark, sf_dir))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def on_findings(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql and FOUND + sql)(lambda spark, d: f(findings(spark, d)))


# Detectors over documents and pages, one key for each rule. For rules whose values the documents don't hold each text gets one
# behind it, made from its id; where it is, and that nothing else is found, their SQL says by itself: what is before the value, the
# value and what is behind it, as templates.
BEHIND = {
    "ssn-label": ("SSN: ", "{d3}-{d2}-{d4}", "."), "honorific-name": ("with ", "Dr. Q{l6} W{l4}", ", who"), "messenger-handle": ("(", "@{l7}_{d2}", ")"),
    "tel-uri": ("<", "tel:+1{d9}", ">"), "url-userinfo": ("at https://", "{l5}:{x12}", "@db.example.org/x"), "password-hash": ("hash ", "$2b$1{d1}${x53}", ";"),
    "private-key": ("", "-----BEGIN RSA PRIVATE KEY-----{n}{x60}{n}-----END RSA PRIVATE KEY-----", ""), "authorization": ("Authorization: Bearer ", "{x30}", ""),
}


def behind(before: str, value: str, after: str) -> str:
    """SQL of both engines: the text, a line break, and the templates filled."""
    return f"concat(coalesce(text, ''), chr(10), {sample(before, 'doc_id')}, {sample(value, 'doc_id')}, {sample(after, 'doc_id')}, chr(10))"


def expected(before: str, value: str) -> str:
    return f"FROM (SELECT doc_id, CAST(length(coalesce(text, '')) + 1 + length({sample(before, 'doc_id')}) AS BIGINT) AS start, {sample(value, 'doc_id')} AS value FROM documents)"


for _r in DEFAULT:
    if _r.id in BEHIND:
        query("det_" + _r.id.replace("-", "_"), f"SELECT doc_id, start, start + length(value) AS \"end\", '{_r.type}' AS type, '{_r.category}' AS category, '{_r.id}' AS rule, CAST({_r.confidence} AS DOUBLE) AS confidence, value {expected(*BEHIND[_r.id][:2])}")(
            lambda spark, d, r=_r, made=behind(*BEHIND[_r.id]): detect(docs(spark, d).select("doc_id", F.expr(made).alias("text")), [r]))
        continue
    query("det_" + _r.id.replace("-", "_"), detect_sql([_r]))(lambda spark, d, r=_r: detect(docs(spark, d), [r]))
query("det_pages", detect_sql(DEFAULT, "pages", "page_id", "html"))(lambda spark, d: detect(read(spark, d, "pages"), DEFAULT, "page_id", "html"))


def on_samples(name: str, made: Callable[[str], str], found: Callable[[DataFrame], DataFrame], sql: Callable[[str], str]) -> None:
    """A query over every whole text with a sample behind it, which both engines make from the row's id."""
    table = f"(SELECT doc_id, {made('duck')} AS text FROM documents)"
    query(name, sql(table))(lambda spark, d: found(docs(spark, d).select("doc_id", F.expr(made("spark")).alias("text"))))


# Provider tokens: documents hold none, so each text gets one behind it, of the provider's forms in turn. Where it is, and that
# nothing else is found, the SQL says by itself.
def _with_token(name: str) -> tuple[str, str]:
    forms = provider_tokens(name)
    token = "case cast(doc_id % {} as int) {} end".format(len(forms), " ".join(f"when {i} then '{t}'" for i, t in enumerate(forms)))
    return f"concat(coalesce(text, ''), chr(10), '(', {token}, ')', chr(10))", token


for _p in PROVIDERS:
    query("det_provider_" + _p.replace("-", "_"), f"""SELECT doc_id, CAST(n AS BIGINT) AS start, CAST(n + length(token) AS BIGINT) AS "end", 'SECRET' AS type, 'credential' AS category, '{_p}' AS rule, CAST(0.95 AS DOUBLE) AS confidence, token AS value
FROM (SELECT doc_id, length(coalesce(text, '')) + 2 AS n, {_with_token(_p)[1]} AS token FROM documents WHERE doc_id IS NOT NULL)""")(
        lambda spark, d, made=_with_token(_p)[0], r=provider_rule(_p): detect(docs(spark, d).select("doc_id", F.expr(made).alias("text")), [r]))
for _r, _s in FORMATS:
    on_samples("det_" + _r.id.replace("-", "_"), lambda engine, t=with_sample(_s): t, lambda made, r=_r: detect(made, [r]), lambda table, r=_r: detect_sql([r], table))
for _i in IDENTIFIERS:
    on_samples("det_national_" + _i.type.lower(), lambda engine, t=with_sample(_i.sample): t, lambda made, i=_i: detect_national(made, [i]), lambda table, i=_i: national_sql(i, table))

# Policy.
on_findings("pol_likelihood", "SELECT doc_id, start, rule, CASE WHEN confidence >= .9 THEN 'VERY_LIKELY' WHEN confidence >= .7 THEN 'LIKELY' WHEN confidence >= .4 THEN 'POSSIBLE' WHEN confidence >= .2 THEN 'UNLIKELY' ELSE 'VERY_UNLIKELY' END AS likelihood FROM f",
            lambda f: f.select("doc_id", "start", "rule", S.likelihood(F.col("confidence")).alias("likelihood")))
on_findings("pol_rules", "SELECT doc_id, start, rule FROM f WHERE rule NOT IN ('ipv4', 'messenger-handle')", lambda f: f.where(~F.col("rule").isin("ipv4", "messenger-handle")).select("doc_id", "start", "rule"))
on_findings("pol_credonly", "SELECT doc_id, start, \"end\", rule FROM f WHERE category = 'credential'", lambda f: f.where("category = 'credential'").select("doc_id", "start", "end", "rule"))
on_findings("pol_allow", "SELECT doc_id, start, rule, value FROM f WHERE category = 'credential' OR NOT (regexp_full_match(value, '(?:10|192\\.168)\\..*') OR value LIKE '%@example.com')",
            lambda f: f.where((F.col("category") == "credential") | ~(F.col("value").rlike(r"^(?:10|192\.168)\..*$") | F.col("value").endswith("@example.com"))).select("doc_id", "start", "rule", "value"))
on_findings("pol_localip", "SELECT doc_id, start, value, list_contains(['10', '127'], string_split(value, '.')[1]) OR value LIKE '192.168.%' OR value LIKE '169.254.%' OR (value LIKE '172.%' AND CAST(string_split(value, '.')[2] AS INT) BETWEEN 16 AND 31) AS local FROM f WHERE rule = 'ipv4'",
            lambda f: f.where("rule = 'ipv4'").select("doc_id", "start", "value", F.expr("split(value, '[.]')[0] IN ('10', '127') OR value LIKE '192.168.%' OR value LIKE '169.254.%' OR (value LIKE '172.%' AND int(split(value, '[.]')[1]) BETWEEN 16 AND 31)").alias("local")))
# Joins.
on_findings("join_contain_public", "SELECT doc_id, start, rule FROM f WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.rule = 'national-phone' AND p.doc_id = f.doc_id AND p.type = f.type AND p.start <= f.start AND p.\"end\" >= f.\"end\")",
            lambda f: P.contained_anti(f, f.where("rule = 'national-phone'")).select("doc_id", "start", "rule"))
# An address within a URL's user and password is no personal finding of its own.
_url = ("at https://me:", "pw{d4}@db{d3}.example.org", "/x")
query("join_contain_fake", f"SELECT doc_id, start, 'email' AS rule, value {expected(*_url[:2])}")(
    lambda spark, d: P.overlapping(detect(docs(spark, d).select("doc_id", F.expr(behind(*_url)).alias("text"))), F.col("category") == "personal", F.col("category") == "credential").select("doc_id", "start", "rule", "value"))


@query("join_line", FOUND + "SELECT f.doc_id, f.start, f.rule, CAST(len(string_split(substr(d.text, 1, f.start), chr(10))) AS BIGINT) AS line, CAST(length(list_last(string_split(substr(d.text, 1, f.start), chr(10)))) + 1 AS BIGINT) AS col FROM f JOIN documents d USING (doc_id)")
def _line(spark, d):
    f = findings(spark, d).join(docs(spark, d), "doc_id")
    before = F.split(F.substring("text", F.lit(1), F.col("start").cast("int")), "\n", -1)
    return f.select("doc_id", "start", "rule", before.alias("ls")).select("doc_id", "start", "rule", F.size("ls").cast("long").alias("line"), (F.length(F.element_at("ls", -1)) + 1).cast("long").alias("col"))


@query("join_baseline", FOUND + f", g AS ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')}), n AS (SELECT *, sha256(concat_ws('|', rule, type, value)) AS fp, row_number() OVER (PARTITION BY rule, type, value ORDER BY doc_id, start) AS rn FROM f), b AS (SELECT sha256(concat_ws('|', rule, type, value)) AS fp, count(*) AS n FROM g GROUP BY 1) SELECT doc_id, start, rule FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.fp = n.fp AND n.rn <= b.n)")
def _baseline(spark, d):
    """Findings that the baseline, a multiset of fingerprints taken from the pages, doesn't cover: each entry takes one."""
    mark = F.sha2(F.concat_ws("|", "rule", "type", "value"), 256).alias("fp")
    known = detect(read(spark, d, "pages"), DEFAULT, "page_id", "html").groupBy(mark).agg(F.count(F.lit(1)).alias("n"))
    f = findings(spark, d).select("doc_id", "start", "rule", mark)
    return P.beyond_baseline(f, known).select("doc_id", "start", "rule")


# Aggregations, windows, sets, sorts.
UNION = ", w AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\" DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f), i AS (SELECT *, sum(CASE WHEN start < top THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, \"end\" DESC, rule) AS island FROM w), u AS (SELECT doc_id, min(start) AS start, max(\"end\") AS \"end\", CASE WHEN bool_or(category = 'credential') THEN 'credential' ELSE 'personal' END AS category, arg_min(type, (start, -\"end\", rule)) AS type, count(*) AS n_findings FROM i GROUP BY doc_id, island)\n"
on_findings("agg_spanunion", UNION + "SELECT * FROM u", P.span_union)
on_findings("agg_samespan", "SELECT doc_id, start, \"end\", type, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, \"end\", type ORDER BY confidence DESC, rule) AS rn FROM f) WHERE rn = 1", lambda f: P.same_span(f).select("doc_id", "start", "end", "type", "rule"))
on_findings("agg_nested", "SELECT doc_id, start, \"end\", rule FROM (SELECT *, max(\"end\") OVER (PARTITION BY doc_id, type ORDER BY start, \"end\" DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f) WHERE top IS NULL OR \"end\" > top", lambda f: P.drop_nested(f).select("doc_id", "start", "end", "rule"))
on_findings("agg_dedupe", "SELECT DISTINCT doc_id, start, \"end\", category, type, rule FROM (SELECT * FROM f UNION ALL SELECT * FROM f)", lambda f: f.unionByName(f).select("doc_id", "start", "end", "category", "type", "rule").dropDuplicates())
on_findings("agg_redactions", UNION + "SELECT doc_id, count(*) AS redactions, count(*) FILTER (WHERE category = 'credential') AS credentials FROM u GROUP BY doc_id", lambda f: P.span_union(f).groupBy("doc_id").agg(F.count(F.lit(1)).alias("redactions"), F.count_if(F.col("category") == "credential").alias("credentials")))
on_findings("agg_seeds", "SELECT doc_id, value, min(type) AS type, count(*) AS n FROM f WHERE confidence >= .85 AND length(value) BETWEEN 2 AND 256 GROUP BY ALL", lambda f: f.where("confidence >= 0.85 AND length(value) BETWEEN 2 AND 256").groupBy("doc_id", "value").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n")))
SQL["agg_seeds"] = SQL["agg_seeds"].replace("GROUP BY ALL", "GROUP BY doc_id, value")
on_findings("agg_number", "SELECT doc_id, type, value, first_start, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first_start) AS number FROM (SELECT doc_id, type, value, min(start) AS first_start FROM f GROUP BY doc_id, type, value)", P.numbered)
on_findings("agg_floors", "SELECT type, max(n) AS floor FROM (SELECT doc_id, type, count(DISTINCT value) AS n FROM f GROUP BY doc_id, type) GROUP BY type", lambda f: f.groupBy("doc_id", "type").agg(F.count_distinct("value").alias("n")).groupBy("type").agg(F.max("n").alias("floor")))
on_findings("agg_sarifrules", "SELECT rule, dense_rank() OVER (ORDER BY first_doc, first_start, rule) - 1 AS rule_index FROM (SELECT rule, min(doc_id) AS first_doc, arg_min(start, (doc_id, start)) AS first_start FROM f GROUP BY rule)",
            lambda f: f.groupBy("rule").agg(F.min(F.struct("doc_id", "start")).alias("p")).select("rule", (F.dense_rank().over(W.orderBy("p", "rule")) - 1).cast("long").alias("rule_index")))
query("agg_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest")))
on_findings("win_runmax", "SELECT doc_id, start, rule, max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\" DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run_max FROM f", lambda f: f.select("doc_id", "start", "rule", F.max("end").over(P.ordered().rowsBetween(W.unboundedPreceding, -1)).alias("run_max")))
on_findings("win_cursor", UNION + "SELECT doc_id, start, start - lag(\"end\", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS gap FROM u", lambda f: P.span_union(f).select("doc_id", "start", (F.col("start") - F.lag("end", 1, 0).over(W.partitionBy("doc_id").orderBy("start"))).alias("gap")))
on_findings("win_firstseen", "SELECT doc_id, value, rank() OVER (PARTITION BY doc_id ORDER BY s) AS seen FROM (SELECT doc_id, value, min(start) AS s FROM f GROUP BY doc_id, value)", lambda f: f.groupBy("doc_id", "value").agg(F.min("start").alias("s")).select("doc_id", "value", F.rank().over(W.partitionBy("doc_id").orderBy("s")).cast("long").alias("seen")))
on_findings("win_nth", "SELECT doc_id, start, rule, row_number() OVER (PARTITION BY value ORDER BY doc_id, start, rule) AS nth FROM f", lambda f: row_numbers(f.select("doc_id", "start", "rule", "value"), ["value"], ["doc_id", "start", "rule"], "nth").drop("value"))
on_findings("sort_findings", "SELECT doc_id, start, \"end\", rule FROM f ORDER BY doc_id, start, \"end\" DESC, rule", lambda f: f.select("doc_id", "start", "end", "rule").orderBy("doc_id", "start", F.desc("end"), "rule"))
on_findings("set_except", "SELECT DISTINCT doc_id, value FROM f WHERE (doc_id, value) NOT IN (SELECT (doc_id, value) FROM f WHERE type = 'PHONE')", lambda f: f.select("doc_id", "value").subtract(f.where("type = 'PHONE'").select("doc_id", "value")))
query("set_union", f"SELECT doc_id AS id, rule, count(*) AS n FROM ({detect_sql(DEFAULT)}) GROUP BY doc_id, rule UNION ALL SELECT page_id, rule, count(*) FROM ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')}) GROUP BY page_id, rule")(
    lambda spark, d: findings(spark, d).groupBy(F.col("doc_id").alias("id"), "rule").agg(F.count(F.lit(1)).alias("n")).unionByName(detect(read(spark, d, "pages"), DEFAULT, "page_id", "html").groupBy(F.col("page_id").alias("id"), "rule").agg(F.count(F.lit(1)).alias("n"))))

# Scalar functions over the values found or over columns of the star schema.
on_findings("fn_entropy", "SELECT doc_id, start, rule, round(list_entropy(string_split(value, '')), 6) AS entropy FROM f", lambda f: f.select("doc_id", "start", "rule", F.round(S.entropy(F.col("value")), 6).alias("entropy")))
on_findings("fn_cardnetwork", "SELECT doc_id, start, CASE WHEN value[1] = '4' THEN 'visa' WHEN CAST(value[1:2] AS INT) BETWEEN 51 AND 55 OR CAST(value[1:4] AS INT) BETWEEN 2221 AND 2720 THEN 'mastercard' WHEN value[1:2] IN ('34', '37') THEN 'amex' WHEN value[1:4] = '6011' OR value[1:2] = '65' THEN 'discover' WHEN CAST(value[1:4] AS INT) BETWEEN 3528 AND 3589 THEN 'jcb' ELSE 'unknown' END AS network FROM (SELECT doc_id, start, translate(value, ' -', '') AS value FROM f WHERE rule = 'luhn')", lambda f: f.where("rule = 'luhn'").select("doc_id", "start", S.card_network(F.col("value")).alias("network")))


@query("fn_mod97", "SELECT o_orderkey, CAST(('5' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '131400')::HUGEINT % 97 AS INT) AS rest FROM orders")
def _mod97(spark, d):
    iban = F.concat(F.lit("DE00"), F.lit("5"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return read(spark, d, "orders").select("o_orderkey", S.mod97(iban).alias("rest"))


query("fn_weighted", "SELECT c_custkey, CAST(list_sum(list_transform(range(1, 10), lambda i: CAST(lpad(CAST(c_custkey AS VARCHAR), 9, '0')[i] AS INT) * (11 - i))) % 11 AS INT) AS rest FROM customer")(
    lambda spark, d: read(spark, d, "customer").select("c_custkey", (S.weighted(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), list(range(10, 1, -1))) % 11).alias("rest")))
query("fn_fieldnorm", "SELECT DISTINCT event_type, lower(regexp_replace(event_type, '[^A-Za-z0-9]', '', 'g')) AS field FROM events")(lambda spark, d: read(spark, d, "events").select("event_type", F.lower(F.regexp_replace("event_type", "[^A-Za-z0-9]", "")).alias("field")).distinct())
query("fn_encode", "SELECT event_id, to_base64(encode(event_type)) AS b64, lower(hex(event_type)) AS hexed FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", F.base64(F.encode("event_type", "utf-8")).alias("b64"), F.lower(F.hex(F.encode("event_type", "utf-8"))).alias("hexed")))

# Transformations.
on_findings("tx_hivemask", "SELECT doc_id, start, rule, CASE WHEN length(value) > 12 THEN concat(left(value, 3), '…', right(value, 3)) ELSE '[REDACTED]' END AS masked FROM f", lambda f: f.select("doc_id", "start", "rule", S.hive_mask(F.col("value")).alias("masked")))
on_findings("tx_mask", "SELECT doc_id, start, rule, CASE WHEN length(value) < 5 OR length(value) <= 4 THEN '[REDACTED]' ELSE concat(left(value, 2), repeat('*', length(value) - 4), right(value, 2)) END AS masked FROM f", lambda f: f.select("doc_id", "start", "rule", S.mask(F.col("value"), 2, 2).alias("masked")))
on_findings("tx_identitymask", "SELECT doc_id, start, rule, CASE WHEN length(value) < 5 THEN '[REDACTED]' ELSE concat(left(value, 2), '***', right(value, 2)) END AS masked FROM f", lambda f: f.select("doc_id", "start", "rule", S.identity_mask(F.col("value")).alias("masked")))
_in, _out = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
on_findings("tx_pseudonym", f"SELECT doc_id, start, concat('[PSEUDONYM_', left(sha256(unhex('{_out}') || unhex(sha256(unhex('{_in}') || encode(concat(type, '|', value))))), 24), ']') AS token FROM f", lambda f: f.select("doc_id", "start", F.concat(F.lit("[PSEUDONYM_"), F.left(S.hmac_sha256(KEY, F.concat("type", F.lit("|"), "value")), F.lit(24)), F.lit("]")).alias("token")))
query("tx_dateshift", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 37 AS VARCHAR) AS shifted FROM orders")(lambda spark, d: read(spark, d, "orders").select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), 37).cast("string").alias("shifted")))
query("tx_bucket", "SELECT p_partkey, concat(CAST(p_size // 10 * 10 AS VARCHAR), '–', CAST(p_size // 10 * 10 + 9 AS VARCHAR)) AS bucket FROM part")(lambda spark, d: read(spark, d, "part").select("p_partkey", S.bucket(F.col("p_size"), 10).alias("bucket")))


def _crypt(f: DataFrame) -> DataFrame:
    iv = F.unhex(F.left(S.hmac_sha256(KEY, F.concat("type", F.lit("|"), "value")), F.lit(24)))
    key = F.unhex(F.sha2(F.lit(KEY), 256))
    sealed = f.withColumn("sealed", F.aes_encrypt(F.encode("value", "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode("type", "utf-8")))
    return sealed.select("doc_id", "start", "rule", F.decode(F.aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), F.encode("type", "utf-8")), "utf-8").alias("value"))


on_findings("tx_encrypt_decrypt", "SELECT doc_id, start, rule, value FROM f", _crypt)


def _redacted(spark, d):
    return P.render(docs(spark, d), P.span_union(findings(spark, d)).withColumn("replacement", F.lit("[REDACTED]")))


RENDER = UNION + ", r AS (SELECT doc_id, list(start ORDER BY start) AS s, list(\"end\" ORDER BY start) AS e FROM u GROUP BY doc_id)\n"
query("tx_redact", FOUND + RENDER + "SELECT d.doc_id, CASE WHEN s IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE e[i - 1] + 1 END, CASE WHEN i = len(s) + 1 THEN length(text) ELSE s[i] END - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END)), '[REDACTED]') END AS text, CAST(coalesce(len(s), 0) AS BIGINT) AS redactions FROM documents d LEFT JOIN r USING (doc_id)")(_redacted)
@query("tx_restore", "SELECT doc_id, text FROM documents")
def _restore(spark, d):
    """Placeholders out and back: each document's own map gives the values again, longest token first."""
    from ..operators.placeholders import placeholders, restore

    return restore(placeholders(docs(spark, d), findings(spark, d)))


# Sinks and reports.
on_findings("snk_result", "SELECT type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM f GROUP BY type", lambda f: f.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents")))
on_findings("snk_baseline", "SELECT sha256(concat_ws('|', rule, type, value)) AS fingerprint, count(*) AS n FROM f GROUP BY 1", lambda f: f.groupBy(F.sha2(F.concat_ws("|", "rule", "type", "value"), 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n")))

# Sources.
query("src_jsonl", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("src_report_offsets", FOUND + "SELECT f.doc_id, f.start, CAST(strlen(substr(d.text, 1, f.start)) AS BIGINT) AS byte_start FROM f JOIN documents d USING (doc_id)")(lambda spark, d: findings(spark, d).join(docs(spark, d), "doc_id").select("doc_id", "start", F.octet_length(F.substring("text", F.lit(1), F.col("start").cast("int"))).cast("long").alias("byte_start")))
query("src_report_detectsecrets", FOUND + ", l AS (SELECT DISTINCT f.doc_id, len(string_split(substr(d.text, 1, f.start), chr(10))) AS line FROM f JOIN documents d USING (doc_id) WHERE rule = 'context') SELECT l.doc_id, CAST(line AS BIGINT) AS line, string_split(text, chr(10))[line] AS content FROM l JOIN documents USING (doc_id)")(
    lambda spark, d: findings(spark, d).where("rule = 'context'").join(docs(spark, d), "doc_id").select("doc_id", "text", F.size(F.split(F.substring("text", F.lit(1), F.col("start").cast("int")), "\n", -1)).cast("long").alias("line")).distinct().select("doc_id", "line", F.get(F.split("text", "\n", -1), (F.col("line") - 1).cast("int")).alias("content")))

# JSON texts, one for each customer, written alike by both engines.
_json = """concat('{"id":', cast(c_custkey as string), ',"who":{"full_name":"', c_name, '","segment":"', c_mktsegment, '"},"tags":["t', cast(c_custkey as string), 'x","u', cast(c_custkey as string), 'y"],"open":true}')"""
LEAVES = f"WITH j AS (SELECT c_custkey, {_json} AS text FROM customer), l AS (SELECT c_custkey, text, replace(replace(replace(t.fullkey, '$.', ''), '[', '.'), ']', '') AS path, t.atom ->> '$' AS value FROM j, json_tree(j.text) t WHERE t.type = 'VARCHAR') "


def json_docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.expr(_json).alias("text"))


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return J.leaves(json_docs(spark, d), "c_custkey")


def dotted() -> Column:
    return F.concat_ws(".", "path").alias("path")


query("src_json", LEAVES + "SELECT c_custkey, path, value, CAST(strpos(text, concat('\"', value, '\"')) AS BIGINT) AS start FROM l")(
    lambda spark, d: json_leaves(spark, d).where("NOT is_key").select("c_custkey", dotted(), "value", "start"))
query("pol_field_match", LEAVES + "SELECT c_custkey, path, value FROM l WHERE path LIKE 'who.%' OR path = 'tags.1'")(
    lambda spark, d: json_leaves(spark, d).where(~F.col("is_key") & (J.field_matches("who.*") | J.field_matches("tags.1"))).select("c_custkey", dotted(), "value"))
query("pol_field_allowed", LEAVES + "SELECT c_custkey, path, 'JSON_VALUE' AS type FROM l WHERE path NOT IN ('who.segment', 'tags.0', 'tags.1')")(
    lambda spark, d: J.beyond_allowed(json_leaves(spark, d), ["segment", "tags.*"]).select("c_custkey", dotted(), "type"))
query("pol_field_sensitive", LEAVES + "SELECT c_custkey, replace(text, concat('\"', c_name, '\"'), '\"[REDACTED]\"') AS text FROM j JOIN customer USING (c_custkey)")(
    lambda spark, d: P.render(json_docs(spark, d), json_leaves(spark, d).where(~F.col("is_key") & J.field_matches("fullName")).withColumn("replacement", F.lit("[REDACTED]")), "c_custkey").select("c_custkey", "text"))
query("agg_records", LEAVES + "SELECT c_custkey, string_split(path, '.')[1] AS parent, count(*) AS n, string_agg(value, ' ' ORDER BY path) AS joined FROM l GROUP BY 1, 2")(
    lambda spark, d: json_leaves(spark, d).where("NOT is_key").groupBy("c_custkey", F.concat_ws(".", F.expr("slice(path, 1, size(path) - 1)")).alias("parent"))
    .agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"])).alias("joined")))


@query("agg_dupkeys", "SELECT p_partkey, 'p_size' AS path, CAST(2 AS BIGINT) AS n FROM part WHERE p_size < 10")
def _dupkeys(spark, d):
    twice = """concat('{"p_size":', cast(p_size as string), ',"', case when p_size < 10 then 'p_size' else 'other' end, '":0}')"""
    return J.duplicate_keys(J.leaves(read(spark, d, "part").select("p_partkey", F.expr(twice).alias("text")), "p_partkey"), "p_partkey")


@query("st_registry", "SELECT conv_id, turn, CASE turn WHEN 0 THEN concat(t, ' Q', conv_id, ' is here') WHEN 1 THEN concat(t, ' my name is [REDACTED]') ELSE concat(t, ' as [REDACTED] said') END AS text, CASE turn WHEN 0 THEN 0 ELSE 1 END :: BIGINT AS n_redacted, turn = 1 AS late, CAST(NULL AS VARCHAR) AS error FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def _registry(spark, d):
    """Each conversation is a stream; the name that its second turn gives is redacted from there on, and was sent before."""
    path = f"{d}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a glob, as the table may be one file
    name = F.concat(F.lit("Q"), F.col("conv_id").cast("string"))
    more = F.when(F.col("turn") == 0, F.concat(F.lit(" "), name, F.lit(" is here"))).when(F.col("turn") == 1, F.concat(F.lit(" my name is "), name)).otherwise(F.concat(F.lit(" as "), name, F.lit(" said")))
    return run_available(spark, redact_stream(turns.withColumn("text", F.concat(F.coalesce("text", F.lit("")), more)), "conv_id", "turn"))


@query("st_twopass", "SELECT conv_id, turn, CASE turn WHEN 0 THEN concat(t, ' [REDACTED] is here') WHEN 1 THEN concat(t, ' my name is [REDACTED]') ELSE concat(t, ' as [REDACTED] said') END AS text, CAST(1 AS BIGINT) AS n_redacted FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)")
def _two_passes(spark, d):
    """The same texts, read as a whole: what the second turn confirms is redacted in the first one too."""
    name = F.concat(F.lit("Q"), F.col("conv_id").cast("string"))
    more = F.when(F.col("turn") == 0, F.concat(F.lit(" "), name, F.lit(" is here"))).when(F.col("turn") == 1, F.concat(F.lit(" my name is "), name)).otherwise(F.concat(F.lit(" as "), name, F.lit(" said")))
    return redact_batch(read(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), more)), "conv_id", "turn")
