"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A text's lines are cut into chunks where a rolling hash over the hashes of the last two lines falls into CUT, so an
inserted line moves no cut but those beside it. Chunks of two lines or more that occur again, in any text, are
removed, but for one: those in the text of the smallest doc_id stay, the first of them there. Chunks are grouped by
their bytes, so equal means equal bytes; the group's 128-bit key then only finds its places, and chunks whose key
stands for different bytes meet by their bytes. Single-line chunks are never removed. A frequent chunk is counted
before it is shuffled and its places are dealt over many tasks.

Null text stays null and has no lines; the empty text has one empty line. Null doc_ids lose against others. Rows
repeated with the same doc_id are the same document, so none makes the other's chunks repeated. Further columns are
kept as they are; n_chars, where there is one, follows the text. An empty table gives no rows. A very long text is an
array of its lines in one row.

Chunks miss most of a short passage that is repeated between other lines, as both its cuts must lie inside it. The
rule is that of the query's SQL, so it stays for op7_line_dedup; for pipelines, line_dedup() with passages removes the same chunks and
looks at each two lines in a row too, which needs no cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, salted_join, table

#: First hexadecimal digits of the rolling hash that cut: 5 of 16, so chunks have about three lines.
CUT = ("0", "1", "2", "3", "4")


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs with ls (lines) and cs: start and n (lines) of each chunk."""
    lines = docs.withColumn("ls", F.split(F.col("text"), "\n", -1)).withColumn("hs", F.transform("ls", lambda x: F.md5(x)))
    cut = lambda i: (i == F.size("ls") - 1) | F.substring(F.md5(F.concat(F.get("hs", i - 1), F.get("hs", i))), 1, 1).isin(*CUT)
    ends = F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.coalesce(cut(i), F.lit(False)))
    cuts = lines.withColumn("es", F.when(F.col("ls").isNotNull(), ends)).drop("hs")
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("es", 1, F.size("es") - 1), lambda e: e + 1))
    chunk = lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("n"))
    return cuts.withColumn("cs", F.when(F.col("es").isNotNull(), F.zip_with(starts, "es", chunk))).drop("es")


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row_id"), F.xxhash64("text").alias("row_hash")]


def removals(docs: DataFrame) -> DataFrame:
    """row_id, row_hash and the starts of the chunks to remove."""
    rows = with_chunks(docs.select("doc_id", "text").where("text IS NOT NULL"))
    body = lambda c: F.array_join(F.slice("ls", c["start"] + 1, c["n"]), "\n")
    several = rows.select(*row_key(), F.transform(F.filter("cs", lambda c: c["n"] > 1), lambda c: F.struct(c["start"].alias("start"), body(c).alias("body"))).alias("cs"))
    # explode_outer: for explode, the optimizer filters by the array's size and puts its whole expression, cuts and hashes, inside.
    each = several.select("row_id", "row_hash", F.explode_outer("cs").alias("c")).where("c IS NOT NULL")
    each = each.select("row_id", "row_hash", F.col("c.start").alias("start"), F.col("c.body").alias("body"), F.xxhash64("c.body").alias("k1"), F.xxhash64(F.lit(1), "c.body").alias("k2"))
    named = F.when(F.col("row_id") == -(2**63), None).otherwise(F.col("row_id"))
    bodies = each.groupBy("k1", "k2", "body").agg(F.count(F.lit(1)).alias("n"), F.min(named).alias("keeper"))
    keys = bodies.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("n"), F.min("keeper").alias("keeper"), F.max("n").alias("most"))
    keys = materialize(keys.where("most > 1").select("k1", "k2", "bodies", "n", F.coalesce("keeper", F.lit(-(2**63))).alias("keeper")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    placed = salted_join(each.select("row_id", "row_hash", "start", "k1", "k2"), keys.where("bodies = 1").drop("bodies"), ["k1", "k2"], "row_id", total)
    clash = keys.where("bodies > 1").select("k1", "k2")
    if not clash.isEmpty():  # a key that stands for different bytes: its chunks meet by their bytes
        own = bodies.where("n > 1").join(clash, ["k1", "k2"]).withColumn("keeper", F.coalesce("keeper", F.lit(-(2**63))))
        apart = salted_join(each, own, ["k1", "k2", "body"], "row_id", total)
        placed = placed.unionByName(apart.select("row_id", "row_hash", "start", F.xxhash64(F.lit(2), "body").alias("k1"), F.xxhash64(F.lit(3), "body").alias("k2"), "keeper"))
    return all_but_first(placed)


def all_but_first(placed: DataFrame) -> DataFrame:
    """row_id, row_hash and gone: the starts of placed but for the first of each key in the keeper's text."""
    starts = placed.groupBy("row_id", "row_hash", "k1", "k2", "keeper").agg(F.array_sort(F.collect_set("start")).alias("ss"))
    gone = starts.select("row_id", "row_hash", F.when(F.col("row_id") == F.col("keeper"), F.slice("ss", 2, F.size("ss"))).otherwise(F.col("ss")).alias("ss")).where(F.size("ss") > 0)
    return gone.groupBy("row_id", "row_hash").agg(F.flatten(F.collect_list("ss")).alias("gone"))


def pairs(docs: DataFrame) -> DataFrame:
    """row_id, row_hash and gone: the first lines of each two lines in a row that stand at an earlier place too.

    Equality is by the 256 bits of SHA-256 in k1 and k2, so that no line is shuffled for it."""
    rows = docs.where("text IS NOT NULL").select(*row_key(), F.split("text", "\n", -1).alias("ls"))
    digest = lambda i: F.sha2(F.concat(F.get("ls", i), F.lit("\n"), F.get("ls", i + 1)), 256)
    each = F.when(F.size("ls") > 1, F.transform(F.sequence(F.lit(0), F.size("ls") - 2), lambda i: F.struct(i.alias("start"), F.unhex(digest(i)).alias("k"))))
    each = rows.select("row_id", "row_hash", F.explode_outer(each).alias("c")).where("c IS NOT NULL")
    each = each.select("row_id", "row_hash", F.col("c.start").alias("start"), F.substring("c.k", 1, 16).alias("k1"), F.substring("c.k", 17, 16).alias("k2"))
    named = F.when(F.col("row_id") == -(2**63), None).otherwise(F.col("row_id"))
    keys = each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(named).alias("keeper")).where("n > 1")
    keys = materialize(keys.select("k1", "k2", "n", F.coalesce("keeper", F.lit(-(2**63))).alias("keeper")))
    return all_but_first(salted_join(each, keys, ["k1", "k2"], "row_id", keys.agg(F.sum("n")).first()[0] or 0))


def line_dedup(docs: DataFrame, passages: bool = False) -> DataFrame:
    """docs with the repeated chunks out of text, and n_lines and n_removed (lines) in a last column, a struct named
    line_dedup (with as many _ behind it as it takes to differ from the names in docs).

    With passages, pairs(), the exact check behind the chunks, takes what their cuts miss: the lines of each passage of two lines or more that stands at an
    earlier place (by doc_id) too, whatever lines are around it. Each line removed stays in the place that its passage was first in, or, where that
    is within another repeated passage, in the first place of that one. Both judge the input, so lines that meet only where a chunk has gone are no passage."""
    cols, report = docs.columns, "line_dedup"
    while report.lower() in map(str.lower, cols):
        report += "_"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), "doc_id", "text").select("r", "text", *row_key())
    found = rows.join(removals(docs).withColumnRenamed("gone", "chunks"), ["row_id", "row_hash"], "left")
    found = found.join(pairs(docs), ["row_id", "row_hash"], "left") if passages else found.withColumn("gone", F.lit(None).cast("array<int>"))
    in_chunks = F.flatten(F.transform(F.filter("cs", lambda c: F.array_contains("chunks", c["start"])), lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))
    in_pairs = F.concat("gone", F.transform("gone", lambda i: i + 1))
    lines = F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<int>")) for x in (in_chunks, in_pairs)]))
    chunked = with_chunks(found).select("r", "text", "ls", F.when(F.col("chunks").isNotNull() | F.col("gone").isNotNull(), lines).alias("gone"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone")), lambda i: F.get("ls", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    done = chunked.select("r", text.alias("text"), F.struct(count("ls").alias("n_lines"), count("gone").alias("n_removed")).alias(report))
    as_before = {"text": F.col("text"), "n_chars": F.when(F.col(f"{report}.n_removed") > 0, F.length("text")).otherwise(F.col("r.n_chars")).cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in cols else None}
    return done.select(*[as_before[c].alias(c) if c in as_before else F.col(f"r.`{c}`").alias(c) for c in cols], report)


def without_passages(docs: DataFrame) -> DataFrame:
    """docs, with their columns, without the lines of their repeated passages: line_dedup() with passages, but for its report."""
    return line_dedup(docs, passages=True).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: md5(x)) AS hs FROM l),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i > 1 AND substr(md5(hs[i - 1] || hs[i]), 1, 1) IN ('0', '1', '2', '3', '4'))) AS es FROM h),
c AS (SELECT doc_id, ls, unnest(list_zip(list_prepend(0, es[:-2]), es)) AS p FROM e),
b AS (SELECT doc_id, p[1] AS s, p[2] - p[1] AS n, array_to_string(ls[p[1] + 1:p[2]], chr(10)) AS body FROM c),
k AS (SELECT body, min({'d': doc_id, 's': s}) AS first FROM b WHERE n > 1 GROUP BY body HAVING count(*) > 1),
m AS (SELECT b.doc_id, b.s, b.n, b.body, k.body IS NOT NULL AND (b.doc_id <> k.first.d OR b.s <> k.first.s) AS gone FROM b LEFT JOIN k ON b.body = k.body AND b.n > 1)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY s) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
