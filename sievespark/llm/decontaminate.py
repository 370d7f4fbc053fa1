"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's window is a set of shingles: its runs of SHINGLE words (all its words, if it has fewer). A text contains a
window only if it contains every shingle of it, so one shingle is a sufficient prefix at containment 1: the rarest,
by occurrences in the corpus. Windows with a shingle that occurs nowhere are out at once. Places of the prefix
shingle in texts give candidate places of the window; those that don't fit into the text (length and positional
bound) are out, and the rest is verified word by word over the window's own length. Texts meet their candidates in one
shuffle, which deals the copies of a frequent text over many tasks.

Null text has no words and no windows; items without words have none. An empty table gives no rows, an empty benchmark
no hits. A very long text is an array of its words in one row. Repeated rows and ids are kept: a text's result
depends on its words alone. Items that share an id count once; a null item_id counts as the empty string. Only
doc_id, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from .base import broadcast_if_small, materialize, salted_join, table

#: Words of a shingle, and rows of the benchmark's tables that may be broadcast (about 100 bytes a row).
SHINGLE, SMALL = 5, 100_000
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, by splitting: extracting all matches of a pattern takes many times as long."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), lambda w: w != "")


def runs(hashed: Column, k: int) -> Column:
    """Hash of the k words from each place on."""
    n = F.size(hashed)
    at = F.sequence(F.lit(0), n - F.lit(k))
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + F.lit(j)) for j in range(k)]))
    return F.when(n >= k, made).otherwise(F.array().cast("array<long>"))


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Items' windows, once each: w, items, n (words), k (words a shingle), shingles."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    cut = F.transform(F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.slice("ws", i + 1, n))
    each = items.select("item", F.explode(cut).alias("ws")).select("item", F.array_join("ws", " ").alias("w"))
    own = each.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("ws", F.split("w", " ")).withColumn("n", F.size("ws"))
    hashed = F.transform("ws", lambda x: F.xxhash64(x))
    k = F.least(F.col("n"), F.lit(SHINGLE))
    shingles = F.coalesce(*[F.when(k == i, runs(hashed, i)) for i in range(1, SHINGLE + 1)])
    return own.select("w", "items", "n", k.alias("k"), shingles.alias("shingles"))


def digest(text: Column) -> tuple[Column, Column]:
    full = F.coalesce(text, F.lit(""))
    return F.xxhash64(full).alias("d1"), F.xxhash64(F.lit(1), full).alias("d2")


def places_of(hashed: DataFrame, windows_of: DataFrame, lengths: list[int]) -> DataFrame:
    """d1, d2, cs (start, n words, w and items of each window that may be there) and n (texts) of each text that may hold one."""
    # explode_outer: for the plain one the optimizer computes all runs twice
    if len(lengths) == 1:
        found = hashed.select("d1", "d2", F.lit(lengths[0]).alias("k"), F.posexplode_outer(runs(F.col("hs"), lengths[0])).alias("pos", "shingle"))
    else:
        of_length = lambda k: F.transform(runs(F.col("hs"), k), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), x.alias("shingle")))
        found = hashed.select("d1", "d2", F.explode_outer(F.flatten(F.array(*map(of_length, lengths)))).alias("e")).select("d1", "d2", "e.k", "e.pos", "e.shingle")
    known = windows_of.select("k", F.explode("shingles").alias("shingle")).distinct()
    hits = materialize(found.join(broadcast_if_small(known, SMALL), ["k", "shingle"]))
    seen = hits.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("seen"))
    spread = windows_of.select("w", "n", "k", F.posexplode("shingles").alias("off", "shingle"))
    prefix = spread.join(seen, ["k", "shingle"], "left").groupBy("w", "n", "k").agg(F.count_if(F.col("seen").isNull()).alias("missing"), F.min(F.struct("seen", "shingle", "off")).alias("p"))
    prefix = prefix.where("missing = 0").select("w", "n", "k", F.col("p.shingle").alias("shingle"), F.col("p.off").alias("off")).join(windows_of.select("w", "items"), "w")
    places = hits.join(broadcast_if_small(materialize(prefix), SMALL), ["k", "shingle"]).where("pos >= off").select("d1", "d2", F.struct((F.col("pos") - F.col("off")).alias("s"), "n", "w", "items").alias("c"))
    return places.groupBy("d1", "d2").agg(F.collect_set("c").alias("cs"), F.count(F.lit(1)).alias("n")).select("d1", "d2", "cs", (F.col("n") / F.size("cs")).cast("long").alias("n"))


def verified(rows: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """rows (with text) and cs, the windows that stand in each; null or empty without any. Only texts that may hold a window are cut into words once more."""
    windows_of = materialize(windows(benchmark, width))
    lengths = [r[0] for r in windows_of.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE numbers
    rows = rows.select("*", *digest(F.col("text")), F.monotonically_increasing_id().alias("row"))
    if not lengths:
        return rows.select("*", F.lit(None).cast("array<struct<s:int,n:int,w:string,items:array<string>>>").alias("cs"))
    hashed = rows.select("d1", "d2", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"))
    candidates = materialize(places_of(hashed, windows_of, lengths))  # they grow with the texts, so they are never broadcast
    both = salted_join(rows, candidates, ["d1", "d2"], "row", candidates.agg(F.sum("n")).first()[0] or 0, "left", "merge")
    fits = lambda ws, c: (c["s"] + c["n"] <= F.size(ws)) & (F.array_join(F.slice(ws, c["s"] + 1, c["n"]), " ") == c["w"])
    # let: where a filter is pushed through a projection, its columns become their expressions, and a text would be cut once for each candidate
    return both.withColumn("cs", F.when(F.col("cs").isNotNull(), let(words(F.col("text")), lambda ws: F.filter("cs", lambda c: fits(ws, c)))))


def marked(rows: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """rows (with text) and n_hit, and items, sorted, of each."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("cs", lambda c: F.sequence(c["s"], c["s"] + c["n"] - 1)))))
    some = F.col("cs").isNotNull() & (F.size("cs") > 0)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("cs", lambda c: c["items"]))))
    found = verified(rows, benchmark, width).withColumn("n_hit", F.when(some, covered).otherwise(0).cast("long"))
    return found.withColumn("items", F.when(some, items).otherwise(F.array().cast("array<string>"))).drop("cs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256."""
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width)
    return found.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs, with their columns, whose texts have no window of the benchmark."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "text")
    return verified(rows, benchmark, width).where(F.coalesce(F.size("cs"), F.lit(0)) <= 0).select("r.*")  # cs once, as the filter computes it


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + n - 1], ' ') AS g, n
       FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
