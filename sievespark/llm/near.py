"""Near duplicates by the Jaccard similarity of their sets of shingles: candidates from SimHash and MinHash, verified exactly.

At similarity 0.8 about ten of 64 fingerprint bits differ, too many for tables that lose no link. So texts are
candidates if the SimHash operator links them, or if they agree in a band of ROWS of their MinHash values: two texts
of similarity s agree in no band with probability (1 - s ** ROWS) ** BANDS, 1e-5 at 0.8. The texts of a bucket make a block
with its smallest, and each block is verified by itself with the search of the similarity join, by whole sets; only these links make
groups, so chains of candidates join nothing. Texts with the same set (128 hash bits) are one node, so copies cost nothing.

Null and empty texts have the empty set and are one group. Repeated rows and ids: see representatives(). An empty table gives no rows, other
columns are kept whatever their names. A very long text is held whole by its task (about 100 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hashes, materialize, salted_join, signed, slices
from .graph import components
from .jaccard_join import named, similar
from .simhash import edges, majority, shingles

BANDS, ROWS = 16, 3
FACTORS = np.random.default_rng(12).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(found), 4096):
        least = np.minimum(least, np.multiply.outer(FACTORS, found[i : i + 4096]).min(1))
    return hashes([row.tobytes() for row in least.reshape(BANDS, ROWS)])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n (shingles), fp, key (a name of the set of shingles), node (its first 8 bytes) and bands of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            each = [shingles(t, width) for t in b.column(1).to_pylist()]
            sets = [np.unique(x) for x in each]
            fp = signed(np.array([majority(x) for x in each], dtype=np.uint64))
            key = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            node = [int.from_bytes(k[:8], "little", signed=True) for k in key]
            yield pa.record_batch({"doc_id": b.column(0), "mark": b.column(2), "n": pa.array([len(x) for x in sets], pa.int64()), "fp": pa.array(fp), "key": pa.array(key, pa.binary()), "node": pa.array(node, pa.int64()), "bands": pa.array([signed(bands(x)) for x in sets], pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(make, "doc_id long, mark long, n long, fp long, key binary, node long, bands array<long>")


def led(rows: DataFrame, by: list[str]) -> DataFrame:
    """leader, node: the smallest node of each bucket that `by` names, with each other node of it."""
    heads = rows.groupBy(*by).agg(F.min("node").alias("leader"), F.max("node").alias("top"), F.count(F.lit(1)).alias("n")).where("leader <> top").drop("top")
    total = heads.agg(F.sum("n")).first()[0] or 0
    return salted_join(rows, materialize(heads), by, "node", total).where("leader <> node").select("leader", "node")


def candidates(made: DataFrame, radius: int) -> DataFrame:
    """leader, node: blocks of nodes that may be similar, from fingerprints and bands. Each node once a block."""
    nodes = materialize(made.where("n > 0").groupBy("key").agg(F.first("node").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    heads = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    linked = edges(materialize(nodes.select("fp").distinct()), radius).where("figures IS NULL")
    both = linked.join(heads.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    pairs = both.where("x <> y").select(F.least("x", "y").alias("leader"), F.greatest("x", "y").alias("node"))
    banded = nodes.select("node", F.posexplode("bands").alias("i", "k"))
    return led(nodes.select("fp", "node"), ["fp"]).unionByName(pairs).unionByName(led(banded, ["i", "k"])).distinct()


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, radius: int = 4) -> DataFrame:
    """The rows of docs, with their columns, of which one stays for each group: the smallest doc_id (nulls last), then
    the smallest hash of the text. Of rows that agree in both, one stays."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    made = materialize(sketches(docs, width))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = materialize(made.groupBy("key", "node").agg(F.min(order).alias("best"), F.max("n").alias("n")).select("key", "node", "n", "best", named(F.col("best.doc_id")), F.col("best.mark").alias("mark")))
    links = similar(docs, nodes, materialize(candidates(made, radius)), width, percent)
    best = nodes.join(components(links).select(F.col("node").alias("key"), "root"), "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    stay = best.select(named(F.col("best.doc_id")), F.col("best.mark").alias("mark")).distinct()
    rows = docs.select(F.struct(*cols).alias("r"), named(F.col("doc_id")), F.xxhash64("text").alias("mark"))
    return rows.join(stay, ["name", "mark"]).dropDuplicates(["name", "mark"]).select("r.*")
