"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its last 16 bytes has CUT zero bits, so that equal
texts are cut alike wherever their bytes come from. A document then is its recipe: the ordered list of its chunks'
identifiers. Chunk bytes move once, each distinct chunk of a task once, to verify that equal digests mean equal
bytes; where they don't, the chunks of that digest are told apart by a rank. Only recipes are compared.

Null text counts as empty; the empty text has an empty recipe, and all empty texts are equal. Of equal texts the row
with the most code points in the original stays, then the smallest doc_id (nulls last), then the first row in the
order of reading; so one row of each group stays, also among rows repeated with the same doc_id, which all count and
each get their row. An empty table gives no rows. A text is held in memory whole, at about three times its bytes. Only
doc_id and text are read; further columns don't matter.

The recipe of a large group is dealt over many tasks, and groups are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, salted_join, slices, table

#: Bits of the rolling hash that must be zero at a cut (mean chunk 2 KB), and the least and largest chunk.
CUT, LEAST, MOST = 11, 256, 16384
GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
WHITE = b" \t\n\x0b\x0c\r"


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):  # after each turn h covers twice as many bytes
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    found, at = [], 0
    for end in [*(np.flatnonzero((h >> np.uint32(32 - CUT)) == 0) + 1).tolist(), n]:
        while end - at > MOST:
            found.append(at := at + MOST)
        if end - at >= LEAST or end == n and end > at:
            found.append(at := end)
    return found


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode().translate(None, WHITE)
    ends = cuts(data)
    return [data[i:j] for i, j in zip([0, *ends], ends)]


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, row (its number), n_code, text_sha256 and the ordered chunk digests of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            parts = [chunks(t) for t in texts]
            yield pa.record_batch({
                "doc_id": b.column(0), "row": pa.array(np.arange(row, row + len(texts))), "n_code": pa.array([len(t or "") for t in texts], pa.int64()),
                "text_sha256": pa.array([hashlib.sha256(b"".join(p)).hexdigest() for p in parts]),
                "recipe": pa.array([[hashlib.blake2b(c, digest_size=digest_bytes).digest() for c in p] for p in parts], pa.list_(pa.binary())),
            })
            row += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, row long, n_code long, text_sha256 string, recipe array<binary>")


def chunk_rows(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """digest and bytes of each chunk, once for each batch that has it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = list({c for t in b.column(0).to_pylist() for c in chunks(t)})
            yield pa.record_batch({"digest": pa.array([hashlib.blake2b(c, digest_size=digest_bytes).digest() for c in own], pa.binary()), "bytes": pa.array(own, pa.binary())})

    return docs.select("text").mapInArrow(make, "digest binary, bytes binary")


def with_ranks(docs: DataFrame, made: DataFrame, clashing: DataFrame, digest_bytes: int) -> DataFrame:
    """Recipes in which a digest that stands for several texts is followed by the rank of its bytes."""
    ranked = clashing.groupBy("digest").agg(F.array_sort(F.collect_set("bytes")).alias("known"))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts = [chunks(t) for t in b.column(1).to_pylist()]
            rows = [(d, i, hashlib.blake2b(c, digest_size=digest_bytes).digest(), c, hashlib.sha256(b"".join(p)).hexdigest()) for d, p in zip(b.column(0).to_pylist(), parts) for i, c in enumerate(p)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string()))], ["doc_id", "i", "digest", "bytes", "text_sha256"])

    told = full.mapInArrow(make, "doc_id long, i int, digest binary, bytes binary, text_sha256 string").join(ranked, "digest")
    told = told.select("text_sha256", "i", F.array_position("known", F.col("bytes")).cast("int").alias("rank")).distinct()
    told = told.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("i", "rank"))).alias("ranks"))
    longer = F.transform("recipe", lambda x, i: F.concat(x, F.coalesce(F.encode(F.col("ranks")[i].cast("string"), "utf-8"), F.lit(b""))))
    return made.join(told, "text_sha256", "left").withColumn("recipe", F.when(F.col("ranks").isNull(), F.col("recipe")).otherwise(longer)).drop("ranks")


def exact_dedup(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    made = materialize(recipes(docs, digest_bytes))
    distinct = chunk_rows(docs, digest_bytes).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    several = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if not several.isEmpty():
        made = materialize(with_ranks(docs, made, distinct.join(several, "digest"), digest_bytes))
    best = F.min(F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = made.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).withColumn("group_size", F.col("n"))
    rows = salted_join(made, groups, ["recipe"], "row", made.count())
    kept = F.col("row") == F.col("best.row")
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_code,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, min({'n': -n_code, 'd': doc_id}) AS best FROM t GROUP BY norm)
SELECT doc_id, best.d AS keep_id, group_size, doc_id = best.d AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
