"""SimHash near-dedup with pivot distance tables.

A fingerprint bit is set if it is set in more than half of the hashes of the text's shingles. Fingerprints link at
`radius` or fewer differing bits. The Hamming distances of each distinct fingerprint to PIVOTS reference fingerprints
are computed once and stored beside it. Distances of two that link differ by the radius at most in every coordinate
(triangle inequality), so pairs with a larger difference are discarded; survivors are verified by their bits.

So that not all pairs meet, the bits are cut into radius + 1 blocks, of which two that link agree in one at least, and
each fingerprint is in the table of each block's value. Where there are so many fingerprints that tables of more than
WHOLE are to be expected, these are dealt anew by blocks of the bits that are left; those that are larger than expected,
as their members are alike, are dealt in pairs of parts (exact, but that work grows with the table's square). So no link
is lost at any size. In a table, rows are in the order of the first distance, and
each is held against those that are near in it. Links that join what is joined already are not given.

Null text counts as empty; a text without words has fingerprint zero and links like any other. Repeated rows and
doc_ids are kept, each row has its result; an empty table gives none. A very long text is counted in tiles. Only doc_id
and text are read. Large groups are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, salted_join, signed, slices, table
from .graph import components

#: Reference fingerprints, rows compared at once, the largest table that is compared as it is, a part of larger ones, the
#: mean size that tables may have if bits were even, and shingles counted at once.
PIVOTS = np.random.default_rng(11).integers(0, 2**64, 24, dtype=np.uint64)
ROWS, WHOLE, HALF, LOAD, TILE = 1 << 16, 1 << 12, 1 << 12, 1 << 9, 1 << 16


def shingles(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of width words, in order; of the whole text if it has fewer words, and none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(data, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    each = [hashed(data[i:j], seed) for i, j in zip((ends - size).tolist(), ends[width - 1 :].tolist())]
    return np.array(each, dtype=np.uint64)


def majority(each: np.ndarray) -> int:
    if not len(each):
        return 0
    tiles = (np.unpackbits(each[i : i + TILE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(each), TILE))
    bits = sum(tiles)
    return int(np.packbits(2 * bits > len(each), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    return majority(shingles(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, row (its number) and fp (the 64 bits as a long) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"doc_id": b.column(0), "row": b.column(2), "fp": pa.array(signed(fp))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(make, "doc_id long, row long, fp long")


def tabled(nodes: DataFrame) -> DataFrame:
    """nodes (fp) and near: the Hamming distance to each pivot, one byte each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            near = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS], axis=1)
            yield pa.record_batch({"fp": b.column(0), "near": pa.array([x.tobytes() for x in near], pa.binary())})

    return nodes.select("fp").mapInArrow(make, "fp long, near binary")


def finer(mask: int, radius: int) -> list[int]:
    """Masks that add a block of bits to mask: one of them at least holds no differing bit of two values within radius that agree in mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cut, cut[1:])]


def survivors(table: np.ndarray, fp: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Indexes of pairs whose links join what all links of each table join, how many pairs there are and how many were verified.

    Rows of a table are together, in the order of their distance to the first pivot. Row i is held against row i + j for
    each j as long as some row is in the same table and within radius of that distance; then the other distances and, of
    the pairs that no coordinate discards, the bits are compared. Pairs that are joined already need no verification."""
    n = len(fp)
    order = np.lexsort((near[:, 0], table))
    table, fp, near = table[order], fp[order], near[order].astype(np.int8)
    root, alive, found, verified = np.arange(n), np.arange(n), [], 0
    for j in range(1, n):
        alive = alive[alive + j < n]
        alive = alive[(table[alive] == table[alive + j]) & (near[alive + j, 0] - near[alive, 0] <= radius)]
        if not len(alive):
            break
        at = alive[root[alive] != root[alive + j]]
        for k in range(1, near.shape[1]):
            at = at[np.abs(near[at, k] - near[at + j, k]) <= radius]
        verified += len(at)
        at = at[np.bitwise_count(fp[at] ^ fp[at + j]) <= radius]
        if len(at):
            found.append(np.stack([at, at + j]))
            while True:  # the roots of linked rows become equal
                x, y = root[at], root[at + j]
                if (x == y).all():
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root != root[root]).any():
                    root = root[root]
    sizes = np.unique(table, return_counts=True)[1]
    one, two = (order[x] for x in np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2
    return one, two, int((sizes * (sizes - 1) // 2).sum()), verified


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) inside the tables (mask, k) of rows; figures: pairs in the tables and pairs verified, in one row of each task with a null."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = pairs = checked = 0

        def linked(t: pa.Table) -> pa.RecordBatch:
            nonlocal pairs, checked
            mask, k, fp = (t.column(c).to_numpy() for c in ("mask", "k", "fp"))
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (k[1:] != k[:-1])])
            near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint8).reshape(len(fp), -1)
            one, two, all_pairs, some = survivors(np.cumsum(new), fp.view(np.uint64), near, radius)
            pairs, checked = pairs + all_pairs, checked + some
            return edge_rows(fp[one], fp[two], None)

        def edge_rows(a: np.ndarray, b: np.ndarray, figures: list[int] | None) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "figures": pa.array([figures] * len(a), pa.list_(pa.int64()))})

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                mask, k = (t.column(c).to_numpy() for c in ("mask", "k"))
                last = int(np.flatnonzero((mask != mask[-1]) | (k != k[-1]))[-1]) + 1 if ((mask != mask[-1]) | (k != k[-1])).any() else 0
                if last:
                    yield linked(t.slice(0, last))
                held, size = t.slice(last).to_batches(), t.num_rows - last
        if size:
            yield linked(pa.Table.from_batches(held).combine_chunks())
        yield edge_rows(np.zeros(1, np.int64), np.zeros(1, np.int64), [pairs, checked])

    return rows.select("mask", "k", "fp", "near").repartition("mask", "k").sortWithinPartitions("mask", "k").mapInArrow(make, "a long, b long, figures array<long>")


def tiles(large: DataFrame) -> DataFrame:
    """Tables of n fingerprints as tables of each two parts of them."""
    parts = F.ceil(F.col("n") / HALF)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.struct(F.least(i, F.col("p")).alias("x"), F.greatest(i, F.col("p")).alias("y")))).alias("t")
    dealt = large.withColumn("p", F.pmod(F.xxhash64("fp"), parts)).select("mask", "k", "fp", "near", pair)
    return dealt.select("mask", F.xxhash64("k", "t.x", "t.y").alias("k"), "fp", "near")


def edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints fp within radius, and figures (see compared)."""
    nodes = materialize(tabled(distinct))
    size, rows, masks, out = nodes.count(), nodes.withColumn("mask", F.lit(0).cast("long")), [0], None
    signed_mask = lambda m: F.lit(int(np.uint64(m).view(np.int64))).cast("long")
    while True:
        children = {m: finer(m, radius) for m in masks}
        cells = F.create_map(*[x for m, fs in children.items() for x in (signed_mask(m), F.array(*map(signed_mask, fs)))])
        masks = sorted({f for fs in children.values() for f in fs})
        dealt = rows.select("fp", "near", F.explode(cells[F.col("mask")]).alias("mask")).withColumn("k", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(dealt.groupBy("mask", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        some = compared(salted_join(dealt, sizes.where(F.col("n") <= WHOLE), ["mask", "k"], "fp", total), radius)
        out = some if out is None else out.unionByName(some)
        if sizes.where(F.col("n") > WHOLE).isEmpty():
            return out
        large = materialize(salted_join(dealt, sizes.where(F.col("n") > WHOLE).withColumn("rows", F.col("n")), ["mask", "k"], "fp", total).withColumnRenamed("rows", "n"))
        if size >> min(m.bit_count() for m in masks) <= LOAD:  # tables are large as their members are alike, not as there are many
            return out.unionByName(compared(tiles(large), radius))
        rows = large.select("fp", "near", "mask")


def rooted(made: DataFrame, radius: int) -> DataFrame:
    """fp and root, the same for fingerprints that links join, of all fingerprints made."""
    nodes = materialize(made.select("fp").distinct())
    roots = components(edges(nodes, radius).where("figures IS NULL")).select(F.col("node").alias("fp"), "root")
    return materialize(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id that links reach; null if all are null)."""
    made = materialize(fingerprints(docs, width))
    sizes = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = materialize(sizes.join(rooted(made, radius), "fp"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = salted_join(roots.select("fp", "root", F.col("n").alias("rows")), groups, ["root"], "fp", roots.count())
    return salted_join(made, named.select("fp", "component_id", F.col("rows").alias("n")), ["fp"], "row", made.count()).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
