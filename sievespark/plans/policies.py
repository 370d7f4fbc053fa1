"""More queries: dictionaries, surroundings of findings, spellings of values, files and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import scalar as S
from ..functions.rules import DEFAULT, Rule
from ..functions.samples import sample, with_sample
from ..operators import known as K
from ..operators import policies as O
from ..operators import reports as R
from ..operators import spans as P
from ..operators import views as V
from ..operators.detect import detect, detect_sql
from ..operators.encoded import RUN, decoded_runs, rewrite_runs
from ..operators.national import EPOCH, NOISE
from ..operators.placeholders import TOKEN, placeholders
from ..operators.propagation import INSIDE, propagated
from ..operators.ranks import row_numbers
from ..sources.files import decode_content
from .queries import BEHIND, FOUND, KEY, QUERIES, SQL, UNION, behind, docs, findings, on_findings, on_samples, query, read

__all__ = ["QUERIES", "SQL"]


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Dictionaries: the first three words of each benchmark item are the known values.
_first = "regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')"


#: Places of known values, for the queries' SQL; %s gives the values.
PLACED = r"""
WITH k AS (%s),
p AS (SELECT doc_id, value, unnest(string_split(text, value)) AS piece, unnest(range(0, len(string_split(text, value)))) AS i FROM documents JOIN k ON value <> '' AND contains(text, value)),
w AS (SELECT *, lead(piece) OVER o AS next, lead(piece, 2) OVER o AS after, CAST(sum(length(piece)) OVER o + i * length(value) AS BIGINT) AS start FROM p WINDOW o AS (PARTITION BY doc_id, value ORDER BY i))
SELECT doc_id, value, start, CAST(start + length(value) AS BIGINT) AS "end" FROM w
WHERE next IS NOT NULL AND NOT regexp_matches(concat(CASE WHEN piece = '' AND i > 0 THEN value ELSE piece END, '~'), '[\p{L}\p{N}_]~$') AND NOT regexp_matches(CASE WHEN next = '' AND after IS NOT NULL THEN value ELSE next END, '^[\p{L}\p{N}_]')
"""


@query("kv_exact", PLACED % f"SELECT DISTINCT {_first} AS value FROM benchmark")
def _exact(spark, d):
    return K.known_values(docs(spark, d), read(spark, d, "benchmark").select(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0).alias("value")))


@query("kv_order", PLACED % r"SELECT DISTINCT unnest([g || ' ' || s, s || ' ' || g, s || ', ' || g, left(g, 1) || '. ' || s, s || ' ' || left(g, 1) || '.']) AS value FROM (SELECT regexp_extract(text, '^[A-Za-z]+') AS g, regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+)', 1) AS s FROM benchmark) WHERE g <> '' AND s <> ''")
def _order_of_names(spark, d):
    """The first two words of each benchmark item as a given name and a surname."""
    names = read(spark, d, "benchmark").select(F.explode(K.name_forms(F.regexp_extract("text", "^[A-Za-z]+", 0), F.regexp_extract("text", "^[A-Za-z]+ ([A-Za-z]+)", 1))).alias("value"))
    return K.known_values(docs(spark, d), names)


# Known values in any case and with other gaps: the words of each, in upper case, against the texts, also with other marks for blanks.
RUNS = r"""
WITH k AS (SELECT DISTINCT value, len(ws) AS n, array_to_string(ws, ' ') AS run FROM (SELECT value, regexp_extract_all(lower(value), '[\p{L}\p{N}]+') AS ws FROM (SELECT %s AS value FROM benchmark))),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, string_split_regex(text, '[\p{L}\p{N}]+') AS g FROM (SELECT doc_id, %s AS text FROM documents)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(0, len(w))) AS i FROM t),
q AS (SELECT *, sum(length(gap) + length(word)) OVER o AS stop, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(gap) OVER o AS g2, lead(gap, 2) OVER o AS g3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, lead(stop, 2) OVER (PARTITION BY doc_id ORDER BY i) AS stop3 FROM q),
b AS (SELECT doc_id, stop - length(word) AS start, stop AS last, 1 AS n, lower(word) AS run, g2, g3 FROM r UNION ALL SELECT doc_id, stop - length(word), stop3, 3, lower(concat(word, ' ', w2, ' ', w3)), g2, g3 FROM r WHERE w3 IS NOT NULL),
h AS (SELECT doc_id, text, value, CAST(start AS BIGINT) AS start, CAST(last AS BIGINT) AS "end", g2, g3, n FROM b JOIN k USING (run, n) JOIN t USING (doc_id))
SELECT doc_id, value, start, "end", substr(text, start + 1, "end" - start) AS found FROM h
WHERE (n = 1 OR (length(g2) BETWEEN 1 AND 5 AND length(g3) BETWEEN 1 AND 5 AND regexp_matches(g2, '%s') AND regexp_matches(g3, '%s'))) AND %s
"""
_three = "upper(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+'))"
for _n, _text in (("kv_case", "text"), ("kv_gaps", "replace(text, ' ', ' | ')"), ("kv_identifiers", "replace(text, ' ', '_')")):
    query(_n, RUNS % (_three, _text, K.GAP, K.GAP, "TRUE"))(lambda spark, d, t=_text: K.known_words(docs(spark, d).select("doc_id", F.expr(t).alias("text")), read(spark, d, "benchmark").select(F.expr(_three.replace("'^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+'", "'^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+', 0")).alias("value"))))
_word = "concat(upper(left(text, 1)), lower(regexp_extract(substr(text, 2), '^[A-Za-z]+'{})))"
query("kv_propercase", RUNS % (_word.format(""), "text", K.GAP, K.GAP, "substr(text, start + 1, \"end\" - start) <> lower(substr(text, start + 1, \"end\" - start))"))(
    lambda spark, d: K.proper_case(K.known_words(docs(spark, d), read(spark, d, "benchmark").select(F.expr(_word.format(", 0")).alias("value")))))


_name = "concat('Customer#', lpad(cast(o_custkey as string), 9, '0'))"


@query("join_secret", "SELECT o_orderkey, c_name AS secret, CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'hex' ELSE 'base64' END AS spelling, CAST(1 AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey")
def _secret(spark, d):
    """Texts that spell a customer's name, plainly or coded, against the names as known secrets."""
    text = f"concat('auth: ', case o_orderkey % 3 when 0 then {_name} when 1 then lower(hex({_name})) else base64(cast({_name} as binary)) end, ';')"
    made = read(spark, d, "orders").select("o_orderkey", F.expr(text).alias("text"))
    return K.known_secrets(made, read(spark, d, "customer").select(F.col("c_name").alias("secret")), "o_orderkey")


query("kv_url", r"SELECT rtrim(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(?:www\.)?', ''), '[?#].*$', ''), '/') AS target, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")(
    lambda spark, d: read(spark, d, "pages").groupBy(F.rtrim(F.regexp_replace(F.regexp_replace(F.lower("url"), r"^[a-z]+://(?:www\.)?", ""), "[?#].*$", ""), F.lit("/")).alias("target"))
    .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")))

# Legal forms behind a company's name.
LEGAL = r",? (?:Ltd|LLC|Inc|Corp|PLC|GmbH|AG|KG|SE|S\.A|S\.L|B\.V|Oy|AB)\.?$"
_company = "concat('\"', s_name, '\"', case s_nationkey % 4 when 0 then ' GmbH' when 1 then ', Inc.' when 2 then ' S.A.' else '' end)"
query("fn_orgcore", f"SELECT s_suppkey, replace(regexp_replace({_company}, {quoted(LEGAL)}, ''), '\"', '') AS core FROM supplier")(
    lambda spark, d: read(spark, d, "supplier").select("s_suppkey", F.replace(F.regexp_replace(F.expr(_company), LEGAL, ""), F.lit('"'), F.lit("")).alias("core")))
query("fn_fold", "SELECT doc_id, md5(translate(lower(text), 'ёſ', 'еs')) AS folded FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", F.md5(F.translate(F.lower("text"), "ёſ", "еs")).alias("folded")))


@query("fn_variants", "SELECT o_orderkey, unnest([strftime(t, '%Y-%m-%d'), strftime(t, '%d/%m/%Y'), strftime(t, '%d.%m.%Y'), strftime(t, '%-d %B %Y')]) AS spelling FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders)")
def _variants(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.date_format(day, p) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy")])).alias("spelling"))


# Surroundings.
query("win_context", detect_sql(DEFAULT, around=(64, 16)))(lambda spark, d: detect(docs(spark, d), around=(64, 16)))
LINED = ", b AS (SELECT f.*, string_split(substr(d.text, 1, f.start), chr(10)) AS ls, string_split(substr(d.text, f.start + 1), chr(10))[1] AS tail FROM f JOIN documents d USING (doc_id)), l AS (SELECT *, concat(ls[-1], tail) AS line, CASE WHEN len(ls) > 1 THEN ls[-2] ELSE '' END AS previous FROM b)\n"
query("win_line", FOUND + LINED + "SELECT doc_id, start, rule, line, previous FROM l")(lambda spark, d: O.with_lines(findings(spark, d), docs(spark, d)).select("doc_id", "start", "rule", "line", "previous"))

_token = next(r for r in DEFAULT if r.id == "context")
on_samples("pol_inline", lambda engine: with_sample('{?pragma: allowlist nextline secret}{n}token = "{x20}" # NOSONA{c:RX}'), lambda made: O.not_suppressed(detect(made, [_token]), made).select("doc_id", "start", "value"),
           lambda table: f"WITH d AS {table}, f AS ({detect_sql([_token], 'd')})" + LINED.replace("documents", "d") + f"SELECT doc_id, start, value FROM l WHERE NOT regexp_matches(line, {quoted(O.SAME_LINE)}) AND NOT regexp_matches(previous, {quoted(O.NEXT_LINE)})")
on_samples("pol_template", lambda engine: with_sample('password = "{c:<x}{l8}{c:>y}"{n}token = "****{c:*k}*****"'), lambda made: O.without_templates(detect(made, [_token])).select("doc_id", "start", "value"),
           lambda table: f"SELECT doc_id, start, value FROM ({detect_sql([_token], table)}) WHERE NOT regexp_matches(value, {quoted(O.TEMPLATE)})")


@query("pol_public_caller", FOUND + f", g AS ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')}) SELECT doc_id, start, rule FROM f WHERE category = 'credential' OR NOT EXISTS (SELECT 1 FROM g WHERE g.type = f.type AND g.value = f.value)")
def _public(spark, d):
    """What pages show is public here."""
    return O.without_public(findings(spark, d), detect(read(spark, d, "pages"), DEFAULT, "page_id", "html")).select("doc_id", "start", "rule")


_order = Rule("custom-order", "personal", "ORDER_ID", "[A-Z]{2}-[0-9]{6}", 0.3, "-", "0-9A-Za-z")
on_samples("det_custom_pattern", lambda engine: with_sample("{c:oc}rder {u2}-{d6}"), lambda made: detect(made, [_order], around=(64, 16)).withColumn("confidence", O.boosted(F.col("confidence"), "order|ticket")).drop("before", "after"),
           lambda table: f"SELECT * EXCLUDE (before, after) REPLACE (CASE WHEN regexp_matches(lower(before), 'order|ticket') OR regexp_matches(lower(after), 'order|ticket') THEN least(1, greatest({O.FLOOR}::DOUBLE, confidence + {O.BOOST}::DOUBLE)) ELSE confidence END AS confidence) FROM ({detect_sql([_order], table, around=(64, 16))})")


def random_like(v: Column) -> Column:
    """4.5 bits a character, or 3 where all are hexadecimal digits, but for 40 of them."""
    return (S.entropy(v) >= F.when(v.rlike("^[0-9A-Fa-f]+$"), 3.0).otherwise(4.5)) & ~v.rlike("^[0-9A-Fa-f]{40}$")


_random = Rule("quoted-entropy", "credential", "SECRET", r"\"[^\"\n]{20,256}\"", 0.8, "\"", "", random_like,
               "list_entropy(string_split(value, '')) >= CASE WHEN regexp_full_match(value, '[0-9A-Fa-f]+') THEN 3 ELSE 4.5 END AND NOT regexp_full_match(value, '[0-9A-Fa-f]{40}')", lead="\"", tail="\"")
on_samples("det_quoted_entropy_any", lambda engine: with_sample('note "{x14}{u12}{l12}"'), lambda made: detect(made, [_random]), lambda table: detect_sql([_random], table))

# Transformations.
_in, _out = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def keyed_shape(kind: Column, value: Column) -> Column:
    """Each digit and letter of A-Z and a-z becomes one of its class, by a keyed digest of type, value and place."""

    def turned(c: Column, i: Column) -> Column:
        n = F.conv(F.left(S.hmac_sha256(KEY, F.concat(kind, F.lit("|"), value, F.lit("|"), i.cast("string"))), F.lit(7)), 16, 10).cast("long")
        return F.when(c.rlike("^[0-9]$"), F.chr(48 + n % 10)).when(c.rlike("^[A-Z]$"), F.chr(65 + n % 26)).when(c.rlike("^[a-z]$"), F.chr(97 + n % 26)).otherwise(c)

    return F.array_join(F.transform(S.chars(value), turned), "")


_n = f"CAST('0x' || left(sha256(unhex('{_out}') || unhex(sha256(unhex('{_in}') || encode(concat(type, '|', value, '|', i - 1))))), 7) AS BIGINT)"
on_findings("tx_formatpreserve", f"""SELECT doc_id, start, rule, string_agg(CASE WHEN regexp_matches(c, '^[0-9]$') THEN chr(CAST(48 + n % 10 AS INT)) WHEN regexp_matches(c, '^[A-Z]$') THEN chr(CAST(65 + n % 26 AS INT)) WHEN regexp_matches(c, '^[a-z]$') THEN chr(CAST(97 + n % 26 AS INT)) ELSE c END, '' ORDER BY i) AS shaped
FROM (SELECT doc_id, start, rule, i, value[i] AS c, {_n} AS n FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM f)) GROUP BY doc_id, start, rule""",
            lambda f: f.select("doc_id", "start", "rule", keyed_shape(F.col("type"), F.col("value")).alias("shaped")))



@query("tx_preserve", """SELECT c_custkey, concat('id ', c_custkey, ' data ', to_base64(encode(concat('write to [REDACTED] of ', lower(c_mktsegment)))), ' end') AS text FROM customer""")
def _preserve(spark, d):
    """An address within base64 goes, and what is around it stays encoded."""
    inner = "concat('write to user', cast(c_custkey as string), '@example.com of ', lower(c_mktsegment))"
    text = F.expr(f"concat('id ', cast(c_custkey as string), ' data ', base64(encode({inner}, 'utf-8')), ' end')")
    email = next(r for r in DEFAULT if r.id == "email").pattern
    made = read(spark, d, "customer").select("c_custkey", text.alias("text"))
    return made.select("c_custkey", rewrite_runs(F.col("text"), lambda t: F.regexp_replace(t, email, "[REDACTED]")).alias("text"))


# Files and reports.


@query("src_encoding", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding, sha256(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents")
def _encoding(spark, d):
    marked = lambda mark, code: F.concat(F.lit(mark), F.encode("text", code))
    content = F.when(F.col("doc_id") % 3 == 0, marked(b"\xff\xfe", "UTF-16LE")).when(F.col("doc_id") % 3 == 1, marked(b"\xfe\xff", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, d).select("doc_id", decode_content(content).alias("c")).select("doc_id", "c.encoding", F.sha2("c.text", 256).alias("digest"), "c.error")


@query("src_utf8err", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ERR_ENCODING' END AS error, CASE WHEN doc_id % 5 = 0 THEN CAST(strlen(text) AS BIGINT) END AS offset, CASE WHEN doc_id % 5 = 0 THEN CAST(len(string_split(text, chr(10))) AS BIGINT) END AS record FROM documents WHERE text IS NOT NULL".replace("AS offset", 'AS "offset"'))
def _utf8err(spark, d):
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff"))).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", decode_content(content).alias("c")).select("doc_id", "c.error", "c.offset", "c.record")


def xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


@query("snk_junit", f"""WITH g AS ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')}),
c AS (SELECT page_id, count(*) AS n, string_agg(concat('<testcase name="', rule, '"><failure type="', category, '">', start, '-', "end", '</failure></testcase>'), '' ORDER BY start, "end", rule) AS cases FROM g GROUP BY page_id)
SELECT page_id, concat('<testsuite name="', replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '" tests="', n, '">', cases, '</testsuite>') AS suite FROM c JOIN pages USING (page_id)""")
def _junit(spark, d):
    pages = read(spark, d, "pages")
    case = lambda x: F.format_string('<testcase name="%s"><failure type="%s">%d-%d</failure></testcase>', xml(x["rule"]), x["category"], x["start"], x["end"])
    cases = detect(pages, DEFAULT, "page_id", "html").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule", "category"))).alias("fs"))
    suite = F.concat(F.lit('<testsuite name="'), xml(F.col("url")), F.lit('" tests="'), F.size("fs").cast("string"), F.lit('">'), F.array_join(F.transform("fs", case), ""), F.lit("</testsuite>"))
    return cases.join(pages.select("page_id", "url"), "page_id").select("page_id", suite.alias("suite"))


# Thresholds are a table: of a type, of a group of types, and of all.
LIMITS = "(SELECT * FROM (VALUES ('USERNAME', 'type', CAST(0.7 AS DOUBLE)), ('CONTACT', 'group', CAST(0.6 AS DOUBLE)), ('', 'all', CAST(0.5 AS DOUBLE))) AS limits(name, kind, least))"
GROUPS = "(SELECT * FROM (VALUES ('PHONE', 'CONTACT'), ('EMAIL', 'CONTACT')) AS groups(type, name))"


def least_confidence(spark, f):
    """f with threshold: that of the finding's type, else of its group, else of all."""
    limits, groups = (spark.sql(x[1:-1]) for x in (LIMITS, GROUPS))
    of = lambda kind, name: limits.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("least").alias("of_" + kind))
    per_group = groups.join(of("group", "name"), "name").select("type", "of_group")
    joined = f.join(of("type", "type"), "type", "left").join(per_group, "type", "left").join(of("all", "x").select("of_all"))
    return joined.select(*f.columns, F.coalesce("of_type", "of_group", "of_all").alias("threshold"))


_limited = FOUND + f", l AS {LIMITS}, g AS {GROUPS}, t AS (SELECT f.*, coalesce((SELECT least FROM l WHERE kind = 'type' AND l.name = f.type), (SELECT least FROM l JOIN g ON g.name = l.name WHERE kind = 'group' AND g.type = f.type), (SELECT least FROM l WHERE kind = 'all')) AS threshold FROM f)\n"
query("pol_threshold", _limited + "SELECT doc_id, start, rule, threshold FROM t")(lambda spark, d: least_confidence(spark, findings(spark, d)).select("doc_id", "start", "rule", "threshold"))
# What pages show is taken for made up here.
query("pol_actionable", _limited + f", m AS (SELECT DISTINCT type, value FROM ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')})) SELECT doc_id, start, \"end\", rule FROM t WHERE (type, value) NOT IN (SELECT (type, value) FROM m) AND (category = 'credential' OR confidence >= threshold)")(
    lambda spark, d: least_confidence(spark, findings(spark, d)).join(detect(read(spark, d, "pages"), DEFAULT, "page_id", "html").select("type", "value").distinct(), ["type", "value"], "left_anti")
    .where("category = 'credential' OR confidence >= threshold").select("doc_id", "start", "end", "rule"))

# A scan's reports.
SCANNED = f"WITH f AS ({detect_sql(DEFAULT, f'(SELECT doc_id, text FROM documents WHERE length(text) <= {R.LONGEST})')}), m AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'ERR_MISSING' ELSE 'ERR_LIMIT' END AS reason FROM documents WHERE text IS NULL OR length(text) > {R.LONGEST})\n"
LOCATED = ", b AS (SELECT f.*, string_split(substr(d.text, 1, f.start), chr(10)) AS ls FROM f JOIN documents d USING (doc_id)), l AS (SELECT *, CAST(len(ls) AS BIGINT) AS line, CAST(length(ls[-1]) + 1 AS BIGINT) AS col FROM b)\n"


def scanned(spark, d):
    return detect(R.read_texts(docs(spark, d)))


@query("agg_complete", SCANNED + "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM m) AS skipped, (SELECT count(*) FROM f) AS findings, NOT EXISTS (SELECT 1 FROM m) AS complete")
def _complete(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(docs(spark, d), "documents").join(n(R.skipped(docs(spark, d)), "skipped")).join(n(scanned(spark, d), "findings")).withColumn("complete", F.col("skipped") == 0)


@query("snk_exit", SCANNED + "SELECT CASE WHEN EXISTS (SELECT 1 FROM m) THEN 2 WHEN EXISTS (SELECT 1 FROM f) THEN 1 ELSE 0 END AS code")
def _exit(spark, d):
    return _complete(spark, d).select(F.when(~F.col("complete"), 2).when(F.col("findings") > 0, 1).otherwise(0).alias("code"))


_cell = r"""concat('"', CASE WHEN regexp_matches({0}, '^[ \t\r\n]*[=+@-]|^[\t\r\n]') THEN '''' ELSE '' END, replace({0}, '"', '""'), '"')""".format
query("snk_csv", SCANNED + LOCATED + f"""SELECT concat('documents/', doc_id) AS path, concat_ws(',', '"finding"', {_cell("concat('documents/', doc_id)")}, '""', {_cell('rule')}, {_cell('type')}, {_cell('category')}, line, col, start, "end", confidence, '""') AS line FROM l
UNION ALL SELECT concat('documents/', doc_id), concat_ws(',', '"skipped"', {_cell("concat('documents/', doc_id)")}, {_cell('reason')}, '""', '""', '""', '""', '""', '""', '""', '""', '""') FROM m""")(
    lambda spark, d: R.csv_lines(R.located(scanned(spark, d), docs(spark, d)), R.skipped(docs(spark, d))))
query("snk_json", SCANNED + LOCATED + """SELECT doc_id, start, concat('{"status":"finding","path":"documents/', doc_id, '","rule":"', rule, '","type":"', type, '","category":"', category, '","line":', line, ',"column":', col, ',"start":', start, ',"end":', "end", ',"confidence":', confidence, '}') AS line FROM l""")(
    lambda spark, d: R.located(scanned(spark, d), docs(spark, d)).select("doc_id", "start", F.to_json(F.struct(F.lit("finding").alias("status"), R.path("doc_id").alias("path"), "rule", "type", "category", "line", "column", "start", "end", "confidence")).alias("line")))
query("snk_sarif", SCANNED + LOCATED + """, o AS (SELECT rule, row_number() OVER (ORDER BY p, rule) - 1 AS i FROM (SELECT rule, min({'d': doc_id, 's': start}) AS p FROM f GROUP BY rule))
SELECT doc_id, start, concat('{"ruleId":"', rule, '","ruleIndex":', i, ',"level":"', CASE category WHEN 'credential' THEN 'error' ELSE 'warning' END, '","message":{"text":"', type, ' found by ', rule, '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"documents/', doc_id, '"},"region":{"startLine":', line, ',"startColumn":', col, ',"charOffset":', start, ',"charLength":', "end" - start, '}}}]}') AS result FROM l JOIN o USING (rule)""")(
    lambda spark, d: R.sarif_results(R.located(scanned(spark, d), docs(spark, d))))


# Annotated spans: what BEHIND puts behind each text, one rule after the other.
@query("agg_benchmark", "SELECT rule, count(*) AS annotated, count(*) AS exact, count(*) AS overlapped FROM documents, (SELECT unnest([{}]) AS rule) GROUP BY rule".format(", ".join(f"'{r}'" for r in BEHIND)))
def _recall(spark, d):
    """Each text is looked through once, with all of them behind it, a line break around each."""
    parts, spans, at = ["coalesce(text, '')"], [], "length(coalesce(text, ''))"
    for rule, (before, value, after) in BEHIND.items():
        b, v, a = (sample(t, "doc_id") for t in (before, value, after))
        parts.append(f"chr(10), {b}, {v}, {a}, chr(10)")
        spans.append(f"struct('{rule}' as rule, cast({at} + 1 + length({b}) as bigint) as start, cast({at} + 1 + length({b}) + length({v}) as bigint) as end)")
        at += f" + 2 + length({b}) + length({v}) + length({a})"
    made = docs(spark, d).select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("text"))
    annotated = docs(spark, d).select("doc_id", F.explode(F.expr(f"array({', '.join(spans)})")).alias("e")).select("doc_id", "e.*")
    return R.recall(annotated, detect(made))


# Redact, and look again at what was written: what is found in each round.
_again = UNION + ", r AS (SELECT doc_id, list(start ORDER BY start) AS s, list(\"end\" ORDER BY start) AS e FROM u GROUP BY doc_id), out AS (SELECT d.doc_id, CASE WHEN s IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE e[i - 1] + 1 END, CASE WHEN i = len(s) + 1 THEN length(text) ELSE s[i] END - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END)), '[REDACTED]') END AS text FROM documents d LEFT JOIN r USING (doc_id))\n"


@query("vf_residual", FOUND + _again + f"SELECT (SELECT count(*) FROM f) AS first_round, (SELECT count(*) FROM ({detect_sql(DEFAULT, 'out')})) AS second_round, (SELECT count(*) FROM out WHERE contains(text, '[REDACTED]')) AS redacted")
def _residual(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    found = findings(spark, d)
    out = P.render(docs(spark, d), P.span_union(found).withColumn("replacement", F.lit("[REDACTED]"))).select("doc_id", "text")
    return n(found, "first_round").join(n(detect(out), "second_round")).join(n(out.where(F.contains("text", F.lit("[REDACTED]"))), "redacted"))


# Runs of base64, hexadecimal digits and percent escapes in texts, and what they say; one of them, by the id, is put behind each text.
_said = "concat('it says ', md5(cast(doc_id as string)))"
_coded = f"case cast(doc_id % 3 as int) when 0 then base64(encode({_said}, 'utf-8')) when 1 then lower(hex(encode({_said}, 'utf-8'))) else regexp_replace(hex(encode({_said}, 'utf-8')), '(..)', '%$1') end"
query("fn_decode", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'base64' WHEN 1 THEN 'hex' ELSE 'percent' END AS coding, {_said} AS plain FROM documents")(
    lambda spark, d: decoded_runs(docs(spark, d).select("doc_id", F.expr(f"concat(coalesce(text, ''), chr(10), '(', {_coded}, ')')").alias("text"))).where(F.startswith("plain", F.lit("it says"))))


# Numbers that are times or counts.
_number = Rule("strict-number", "personal", "NUMBER", "[0-9]{6,20}", 0.9, edge="0-9A-Za-z._-")
query("pol_epoch", f"SELECT doc_id, start, value, (length(value) = 10 AND CAST(value AS HUGEINT) BETWEEN 946684800 AND 4102444799) OR (length(value) = 13 AND CAST(value AS HUGEINT) BETWEEN 946684800000 AND 4102444799999) AS epoch FROM ({detect_sql([_number])})")(
    lambda spark, d: detect(docs(spark, d), [_number]).select("doc_id", "start", "value", F.expr(EPOCH).alias("epoch")))
query("pol_noise", f"SELECT doc_id, start, rule, regexp_matches(before, {quoted(NOISE)}) AS noise FROM ({detect_sql([_number], around=(80, 1))})")(
    lambda spark, d: detect(docs(spark, d), [_number], around=(80, 1)).select("doc_id", "start", "rule", F.col("before").rlike(NOISE).alias("noise")))


@query("pol_limit", FOUND + "SELECT count(*) AS texts, max(n) AS most FROM (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)")
def _limit(spark, d):
    """More than 100,000 findings in a text end the query; none is dropped."""
    n = F.when(F.col("n") > 100_000, F.raise_error(F.lit("ERR_LIMIT")).cast("long")).otherwise(F.col("n"))
    return findings(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("texts"), F.max(n).alias("most"))


# Profiles: what is published has a low threshold and masks identities; documents have the usual one and lose values.
PROFILES = {"publication": (0.3, S.identity_mask), "documents": (0.5, lambda v: F.lit("[REDACTED]"))}
for _profile, (_least, _mask) in PROFILES.items():
    on_findings(f"pol_profile_{_profile}", f"SELECT doc_id, start, rule, {'CASE WHEN length(value) < 5 THEN chr(91) || ' + quoted('REDACTED]') + ' ELSE concat(left(value, 2), ' + quoted('***') + ', right(value, 2)) END' if _profile == 'publication' else quoted('[REDACTED]')} AS shown FROM f WHERE category = 'credential' OR confidence >= {_least}",
                lambda f, least=_least, mask=_mask: f.where((F.col("category") == "credential") | (F.col("confidence") >= least)).select("doc_id", "start", "rule", mask(F.col("value")).alias("shown")))

# What one place confirms, another spells with other marks.
_again_text = behind("by ", "Dr. Q{l6} W{l4}", "") [:-1] + f", {sample('met Dr._Q{l6}-W{l4}, and xDr. Q{l6} W{l4}', 'doc_id')})"
query("join_propagate", f"WITH d AS (SELECT doc_id, {_again_text} AS text FROM documents), f AS ({detect_sql(DEFAULT, 'd')})" + r"""
, s AS (SELECT doc_id, value, min(type) AS type FROM f WHERE confidence >= .85 AND length(value) BETWEEN 2 AND 256 AND NOT contains(value, '\') GROUP BY doc_id, value),
e AS (SELECT doc_id, value, type, text, concat('\Q', regexp_replace(value, '[ _-]+', '\\E[ _-]+\\Q', 'g'), '\E') AS p FROM s JOIN d USING (doc_id)),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM e)),
y AS (SELECT doc_id, value, type, text, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start, length(m[i]) AS n FROM x),
z AS (SELECT doc_id, value, type, start, start + n AS "end", CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS l, substr(text, start + n + 1, 1) AS r FROM y)
SELECT doc_id, value, type, start, "end" FROM z WHERE NOT regexp_matches(l, '%s') AND NOT regexp_matches(r, '%s') AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = z.doc_id AND f.start <= z.start AND f."end" >= z."end")""" % (INSIDE, INSIDE))(
    lambda spark, d: (lambda made: propagated(made, detect(made)))(docs(spark, d).select("doc_id", F.expr(_again_text).alias("text"))))

# Encoded candidates by windows of 65,536 characters; more than 4,096 in one are masked, not decoded.
_encoded = Rule("encoded", "credential", "ENCODED", RUN, 0.5, edge="A-Za-z0-9+/=")
query("agg_encwindow", f"SELECT doc_id, start // 65536 AS part, count(*) AS n, count(*) > 4096 AS masked FROM ({detect_sql([_encoded])}) GROUP BY doc_id, start // 65536")(
    lambda spark, d: detect(docs(spark, d), [_encoded]).groupBy("doc_id", F.floor(F.col("start") / 65536).alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("masked", F.col("n") > 4096))

# The fullest form of a name: the longest known value that begins with a word, where no other is as long.
query("topk_fullest", """WITH k AS (SELECT DISTINCT word, name FROM (SELECT regexp_extract(text, '^[A-Za-z]+') AS word, unnest([regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+'), regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')]) AS name FROM benchmark) WHERE name <> ''),
l AS (SELECT word, max(length(name)) AS n FROM k GROUP BY word) SELECT word, min(name) AS fullest FROM k JOIN l USING (word) WHERE length(name) = n GROUP BY word HAVING count(*) = 1""")(
    lambda spark, d: read(spark, d, "benchmark").select(F.regexp_extract("text", "^[A-Za-z]+", 0).alias("word"), F.explode(F.array(*[F.regexp_extract("text", "^[A-Za-z]+" + " [A-Za-z]+" * n, 0) for n in (1, 2)])).alias("name")).where("name <> ''").distinct()
    .groupBy("word", F.length("name").alias("n")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("c")).groupBy("word").agg(F.max_by(F.struct("name", "c"), "n").alias("m")).where("m.c = 1").select("word", F.col("m.name").alias("fullest")))

# Values in place of others.
_h = f"sha256(unhex('{_out}') || unhex(sha256(unhex('{_in}') || encode({{}}))))".format
_below = "CAST('0x' || left({}, 7) AS BIGINT) % {}".format
on_findings("fake_email", f"SELECT doc_id, start, concat('user-', left({_h(chr(39) + 'EMAIL|' + chr(39) + ' || value')}, 12), '@example.com') AS fake FROM f WHERE rule = 'email'", lambda f: f.where("rule = 'email'").select("doc_id", "start", S.fake_email(KEY, F.col("value")).alias("fake")))
on_findings("fake_phone", f"SELECT doc_id, start, regexp_replace(value, '[0-9]{{3}}([-. ]?)[0-9]{{4}}$', concat('555\\101', lpad(CAST({_below(_h(chr(39) + 'PHONE|' + chr(39) + ' || value'), 100)} AS VARCHAR), 2, '0'))) AS fake FROM f WHERE type = 'PHONE' AND value LIKE '+1 %'".replace("\\101", "\\\\1" + "01").replace("\\\\1", "\\1"),
            lambda f: f.where("type = 'PHONE' AND value LIKE '+1 %'").select("doc_id", "start", S.fake_phone(KEY, F.col("value")).alias("fake")))
query("fake_date", f"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST({_below(_h(quoted('date')), 365)} + 1 AS INT) AS VARCHAR) AS fake FROM orders")(
    lambda spark, d: read(spark, d, "orders").select("o_orderkey", S.fake_date(KEY, F.to_date("o_orderdate")).cast("string").alias("fake")))
_account = "concat('DE00', lpad(cast(c_custkey as string), 18, '3'))"
query("fake_iban", f"""WITH a AS (SELECT c_custkey, concat('DE00', lpad(CAST(c_custkey AS VARCHAR), 18, '3')) AS value FROM customer),
b AS (SELECT c_custkey, string_agg(CAST({_below(_h("value_key"), 10)} AS VARCHAR), '' ORDER BY i) AS turned FROM (SELECT c_custkey, i, concat('IBAN|', value, '|', i) AS value_key FROM (SELECT *, unnest(range(0, 18)) AS i FROM a)) GROUP BY c_custkey)
SELECT c_custkey, concat('DE', lpad(CAST(98 - (turned || '131400')::HUGEINT % 97 AS VARCHAR), 2, '0'), turned) AS fake FROM b""")(
    lambda spark, d: read(spark, d, "customer").repartition("c_custkey").select("c_custkey", S.fake_iban(KEY, F.expr(_account)).alias("fake")))
query("fn_mrz", "SELECT o_orderkey, CAST(list_sum(list_transform(range(1, 10), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', z[i]) - 1) * [7, 3, 1][(i - 1) % 3 + 1] + CASE WHEN z[i] = '<' THEN [7, 3, 1][(i - 1) % 3 + 1] ELSE 0 END)) % 10 AS INT) AS check FROM (SELECT o_orderkey, concat('L', lpad(CAST(o_orderkey AS VARCHAR), 7, '<'), 'Q') AS z FROM orders)".replace("AS check", 'AS "check"'))(
    lambda spark, d: read(spark, d, "orders").select("o_orderkey", S.mrz_check(F.expr("concat('L', lpad(cast(o_orderkey as string), 7, '<'), 'Q')")).alias("check")))

# Values that pages show, as known values, in the documents.
query("join_known", PLACED % f"SELECT DISTINCT value FROM ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')})")(
    lambda spark, d: K.known_values(docs(spark, d), detect(read(spark, d, "pages"), DEFAULT, "page_id", "html").select("value")))


_email_rule = next(r for r in DEFAULT if r.id == "email")
# Addresses behind each text of which some characters are escaped: found in the view, and placed in the text.
_escaped = {"percent": ("%41{l4}%42{l3}", "A{l4}B{l3}"), "entity": ("&#65;{l4}&#66;{l3}", "A{l4}B{l3}"), "slash": ("¦x41{l4}¦x42{l3}", "A{l4}B{l3}")}
for _kind, (_shown, _plain) in _escaped.items():
    query(f"fn_view_{_kind}", f"SELECT doc_id, start, start + length(shown) AS \"end\", value FROM (SELECT doc_id, CAST(length(coalesce(text, '')) + 2 AS BIGINT) AS start, replace({sample(_shown + '@example.org', 'doc_id')}, '¦', chr(92)) AS shown, {sample(_plain + '@example.org', 'doc_id')} AS value FROM documents)")(
        lambda spark, d, kind=_kind, made=f"replace({behind('<', _shown + '@example.org', '>')}, '¦', chr(92))": (lambda views: V.found_in_view(detect(views, [_email_rule]), views).select("doc_id", "start", "end", "value"))(V.view(docs(spark, d).select("doc_id", F.expr(made).alias("text")), kind)))

# Reports of other scanners: what they found as JSON, read again and looked for in the texts.
_reported = "rule = 'context'"
query("src_report_secrets", FOUND + ", " + (PLACED % "SELECT DISTINCT value FROM f WHERE rule = 'context'").strip().removeprefix("WITH "))(
    lambda spark, d: K.known_values(docs(spark, d), R.reported(findings(spark, d).where(_reported).select(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("value").alias("Secret"), "rule"))).otherwise(F.to_json(F.struct(F.col("value").alias("Raw"), F.lit(True).alias("Verified")))).alias("record")))))
query("src_report_utf16", FOUND + "SELECT f.doc_id, f.start, f.\"end\", f.type FROM f")(
    lambda spark, d: R.from_utf16(R.to_utf16(findings(spark, d), docs(spark, d)), docs(spark, d)).select("doc_id", "start", "end", "type"))
query("snk_utf16", FOUND + "SELECT f.doc_id, f.rule, CAST(f.start + len(list_filter(string_split(substr(d.text, 1, f.start), ''), lambda x: unicode(x) > 65535)) AS BIGINT) AS start FROM f JOIN documents d USING (doc_id)")(
    lambda spark, d: R.to_utf16(findings(spark, d), docs(spark, d)).select("doc_id", "rule", "start"))
query("pol_knownonly", FOUND + f", m AS (SELECT DISTINCT type, value FROM ({detect_sql(DEFAULT, 'pages', 'page_id', 'html')})) SELECT doc_id, start, rule FROM f SEMI JOIN m USING (type, value)")(
    lambda spark, d: findings(spark, d).join(detect(read(spark, d, "pages"), DEFAULT, "page_id", "html").select("type", "value").distinct(), ["type", "value"], "left_semi").select("doc_id", "start", "rule"))
query("pol_exempt", FOUND + "SELECT f.doc_id, f.start, f.rule FROM f JOIN documents d USING (doc_id) WHERE f.category = 'credential' OR d.source NOT IN ('src0', 'src1')")(
    lambda spark, d: O.without_exempt(findings(spark, d), read(spark, d, "documents").where(F.col("source").isin("src0", "src1"))).select("doc_id", "start", "rule"))

# The map of a rewritten text, as records, and what it gives back.
ENTRIES = UNION + ", v AS (SELECT u.doc_id, u.start, u.type, substr(d.text, u.start + 1, u.\"end\" - u.start) AS value FROM u JOIN documents d USING (doc_id)), e AS (SELECT doc_id, type, value, min(start) AS s FROM v GROUP BY doc_id, type, value), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY s) AS i FROM e)\n"
_token_of = "concat('[[', upper(type[1]), lower(type[2:]), '-', i, ']]')"
query("snk_map", FOUND + ENTRIES + f"SELECT doc_id, {_token_of} AS token, value FROM n")(
    lambda spark, d: placeholders(docs(spark, d), findings(spark, d)).select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.token", "e.value"))
query("fn_istoken", FOUND + ENTRIES + "SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id")(
    lambda spark, d: placeholders(docs(spark, d), findings(spark, d)).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).cast("long").alias("n")).where("n > 0"))

# A known word and the capitalised words around it.
query("win_adjacent", (RUNS % (_word.format(""), "text", K.GAP, K.GAP, "TRUE")).replace("SELECT doc_id, value, start, \"end\", substr(text, start + 1, \"end\" - start) AS found FROM h", r"SELECT doc_id, value, concat(regexp_extract(substr(text, greatest(1, start - 199), least(start, 200)), '(?:\p{Lu}\p{L}+ ){0,3}\z'), substr(text, start + 1, stop - start), regexp_extract(substr(text, stop + 1, 200), '^(?: \p{Lu}\p{L}+){0,3}')) AS whole FROM (SELECT *, " + "\"end\" AS stop FROM h)"))(
    lambda spark, d: K.extended(K.known_words(docs(spark, d), read(spark, d, "benchmark").select(F.expr(_word.format(", 0")).alias("value"))), docs(spark, d)).select("doc_id", "value", "whole"))
query("sort_longest", "SELECT value, row_number() OVER (ORDER BY length(value) DESC, value) AS place FROM (SELECT DISTINCT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') AS value FROM benchmark) WHERE value <> ''")(
    lambda spark, d: read(spark, d, "benchmark").select(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("value")).where("value <> ''").distinct().transform(lambda v: row_numbers(v, [], [F.desc(F.length("value")), "value"], "place")))
_six = "lpad(cast(c_custkey * 7919 % 1000000 as string), 6, '0')"
query("fn_datepart", f"SELECT c_custkey, try_strptime(concat('20', {_six}), '%Y%m%d') IS NOT NULL AS valid FROM customer")(
    lambda spark, d: read(spark, d, "customer").select("c_custkey", F.expr(C.day(_six)).alias("valid")))
