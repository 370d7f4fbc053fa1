"""Substring dedup by relative Lempel-Ziv parsing.

Every text is cut into overlapping reference blocks: each window of `width` words has an anchor, the leftmost least
hash of its RUN-word runs, and a block is the stretch of text whose windows share one anchor. Equal windows have equal
anchors, so all matches of a block lie in blocks with the same anchor hash, aligned at the anchor. The index of all
blocks is one table keyed by that hash.

A block that stands at a second place as a whole (128 bits of its bytes) is a factor as it is. Any other is parsed
greedily against every indexed block with its anchor hash: from the next window on, the longest match with any of them
is a factor; its ends are found by comparing words byte by byte. The next factor is looked for from the first window
that is not inside the last one, so no window at a factor's border is missed. Factors of `width` words or more are
duplicate spans, and adjoining ones are put together. An anchor hash with more than MANY different blocks isn't
gathered: their windows are told apart one by one, by 128 bits of their bytes, and those that stand twice are found.
A text that occurs again as a whole is a factor of the other; one of its copies in a task stands for them in the index.

A window whose sequence starts twice, be it in one text, is removed at every place. Null text has no words; an empty
table gives no rows. Rows are told apart by their place in the table, so repeated rows, equal doc_ids and null doc_ids
work as any other; a repeated row's windows start twice. A very long text is one row of its task, at about 200 bytes a
word. Only doc_id and text are read; docs must be a table scan (the same rows in the same order if read again).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import flag_array, hashes, materialize, mix, salted_join, signed, slices, table

#: Words of a run that can be an anchor, windows handled at once, and different blocks of an anchor that are compared in one place.
RUN, TILE, MANY = 8, 1 << 19, 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])


class Rolling:
    """Hashes of any run of the words of one text, from sums over prefixes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers(MULTIPLIER, n)[:-1], dtype=np.uint64)])
        self.back = powers(INVERSE, n)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


class Words:
    """The words of a text, and where they are in its bytes once they are joined by one space."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        self.data = b" ".join(self.words)
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def digests(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Two 64-bit numbers for each run of n words from first on, of its bytes."""
        spans = zip(self.starts[first].tolist(), self.ends[first + n - 1].tolist())
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(self.data[i:j]) for i, j in spans]), np.int64).reshape(-1, 2)


def anchors(values: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows and the anchor's place behind the first word, of each block."""
    n = len(values) - width + 1
    roll, run = Rolling(values), min(RUN, width)
    span = width - run + 1
    out = []
    for at in range(0, n, TILE):
        m = min(TILE, n - at)
        pos = np.arange(m + span - 1)
        h = roll(at + pos, at + pos + run)
        low = (h >> np.uint64(20) << np.uint64(20)) | pos.astype(np.uint64)
        w = 1
        while w < span:
            step = min(w, span - w)
            low = np.minimum(low[: len(low) - step], low[step:])
            w += step
        where = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        out.append((h[where[first]], at + first, np.diff(np.concatenate([first, [m]])), where[first] - first))
    return tuple(np.concatenate(x) for x in zip(*out))


def block_index(rows: DataFrame, width: int) -> DataFrame:
    """h, b1 and b2 (of the bytes), row, at and n (its windows), off (of the anchor) of each block; of equal texts in a task once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, "text"):
            parts = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark = xxhash.xxh3_128_digest(t)
                if mark in seen:
                    continue
                seen.add(mark)
                own = Words(t)
                if len(own.words) >= width:
                    h, at, n, off = anchors(hashes(own.words), width)
                    parts.append((signed(h), own.digests(at, n + width - 1), np.full(len(h), row), at, n, off))
            if parts:
                h, block, row, at, n, off = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(block[:, 0]), pa.array(block[:, 1]), pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(off.astype(np.int16))], ["h", "b1", "b2", "row", "at", "n", "off"])

    return rows.select("row", "text").mapInArrow(make, "h long, b1 long, b2 long, row long, at int, n short, off short")


PLACED = "h long, g long, single boolean, row long, at int, n short, off short, body binary, w1 long, w2 long"


def placed_blocks(listed: DataFrame, width: int) -> DataFrame:
    """Rows of text and blocks become one row for each block with its bytes, or for each window where there are too many blocks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for row, t, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own, found = Words(t), blocks.values
                h, g, single, at, n, off = (found.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                for which in (g <= MANY, g > MANY):
                    if not which.any():
                        continue
                    i, a, k = np.flatnonzero(which), at[which].astype(np.int64), n[which].astype(np.int64)
                    if g[i[0]] <= MANY:
                        bodies = [own.data[x:y] for x, y in zip(own.starts[a].tolist(), own.ends[a + k + width - 2].tolist())]
                        digest, times = np.zeros((len(i), 2), np.int64), k
                    else:
                        a, times = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k), np.ones(k.sum(), np.int64)
                        bodies, digest, i = [None] * len(a), own.digests(a, np.full(len(a), width)), np.repeat(i, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[i]), pa.array(g[i]), pa.array(single[i]), pa.array(np.full(len(i), row)), pa.array(a.astype(np.int32)), pa.array(times.astype(np.int16)),
                        pa.array(off[i].astype(np.int16)), pa.array(bodies, pa.binary()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    ], [x.split()[0] for x in PLACED.split(", ")])

    return listed.select("row", "text", "blocks").mapInArrow(make, PLACED)


def match(a: list[bytes], at: int, b: list[bytes], bt: int) -> tuple[int, int]:
    """Start and end, in a, of the longest run of words around its place `at` that b has around bt."""
    end, most = at, min(len(a), at + len(b) - bt)
    while end < most and a[end] == b[end - at + bt]:
        end += 1
    start, least = at, max(0, at - bt)
    while start > least and a[start - 1] == b[start - 1 - at + bt]:
        start -= 1
    return start, end


def parse(words: list[bytes], anchor: int, others: list[tuple[list[bytes], int]], width: int) -> list[tuple[int, int]]:
    """Greedy factors (start, end) of width words or more of a block against others, which are (words, anchor)."""
    matches = [m for m in (match(words, anchor, o, p) for o, p in others) if m[1] - m[0] >= width]
    found, at = [], min((m[0] for m in matches), default=0)
    while matches and at + width <= len(words):
        end = max((e for s, e in matches if s <= at), default=0)
        if end - at >= width:
            found.append((at, end))
            at = end - width + 1  # the first window that this factor doesn't hold
        else:
            at = min((s for s, e in matches if s > at), default=len(words))
    return found


def parsed(placed: DataFrame, width: int) -> DataFrame:
    """row, at and n: windows of the single blocks that lie in a factor. An anchor's blocks come one behind the other."""

    def factors(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        blocks = [(body.split(b" "), off) for _, _, _, body, off in group]
        for i, (single, row, at, _, _) in enumerate(group):
            if single:
                for start, end in parse(*blocks[i], [x for j, x in enumerate(blocks) if j != i], width):
                    yield row, at + start, end - start - width + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for h, *block in zip(*(x.to_pylist() for x in b.columns)):
                if h != key:
                    out += factors(group)
                    key, group = h, []
                group.append(block)
            yield rows(out)
        yield rows(list(factors(group)))

    def rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        x = np.array(found, dtype=np.int64).reshape(-1, 3)
        return pa.record_batch({"row": pa.array(x[:, 0]), "at": pa.array(x[:, 1].astype(np.int32)), "n": pa.array(x[:, 2].astype(np.int16))})

    ordered = placed.select("h", "single", "row", "at", "body", "off").repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(make, "row long, at int, n short")


def factored(rows: DataFrame, width: int) -> DataFrame:
    """row, at and n: windows at, at + 1, ..., at + n - 1 of a row that start elsewhere too."""
    blocks = block_index(rows, width)
    differ = (F.min("b1") != F.max("b1")) | (F.min("b2") != F.max("b2"))
    index = materialize(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), differ.alias("differ")).where("n > 1"))
    hits = materialize(salted_join(blocks.withColumnRenamed("n", "k"), index, ["h"], "row", index.agg(F.sum("n")).first()[0] or 0))
    mixed = hits.where("differ")
    first = [F.first(c).alias(c) for c in ("row", "at", "k", "off")]
    distinct = materialize(mixed.groupBy("h", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), *first))
    several = distinct.where("n > 1").select("h", "b1", "b2", "n")
    whole = hits.where("NOT differ").unionByName(salted_join(mixed, several, ["h", "b1", "b2"], "row", several.agg(F.sum("n")).first()[0] or 0))
    groups = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 1).alias("singles")).where("singles > 0").drop("singles").withColumn("g", F.col("n"))
    marked = salted_join(distinct.select("h", (F.col("n") == 1).alias("single"), "row", "at", "k", "off"), groups, ["h"], "row", distinct.count())
    listed = marked.groupBy("row").agg(F.collect_list(F.struct("h", "g", "single", "at", "k", "off")).alias("blocks"))
    placed = materialize(placed_blocks(rows.join(listed, "row"), width))
    windows = placed.where(F.col("g") > MANY)
    again = windows.groupBy("h", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    apart = salted_join(windows.where("single").select("h", "w1", "w2", "row", "at"), again, ["h", "w1", "w2"], "row", placed.count())
    found = parsed(placed.where(F.col("g") <= MANY), width)
    return whole.select("row", "at", F.col("k").alias("n")).unionByName(apart.select("row", "at", F.lit(1).cast("short").alias("n"))).unionByName(found)


def copied(rows: DataFrame) -> DataFrame:
    """row of each text that stands in another row too."""
    marked = rows.select("row", F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(1), "text").alias("m2"))
    several = materialize(marked.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return salted_join(marked, several, ["m1", "m2"], "row", several.agg(F.sum("n")).first()[0] or 0).select("row")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))


def put_together(gone: np.ndarray) -> list[tuple[int, int]]:
    """Spans (start, end) of the words that are gone."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(step[::2].tolist(), step[1::2].tolist()))


def substring_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (of removed words), kept (text)."""
    rows = numbered(docs)
    found = factored(rows, width).unionByName(copied(rows).select("row", F.lit(0).alias("at"), F.lit(-1).cast("short").alias("n")))
    spans = materialize(found.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans")))
    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
            for t, found in zip(b.column(1).to_pylist(), b.column(2)):
                words = kept = t.encode().split()
                gone = []
                if found.is_valid and len(words) >= width:
                    at, n = (found.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                    flags = flag_array(len(words), at, np.where(n < 0, len(words), at + n + width - 1))
                    gone, kept = put_together(flags), [words[i] for i in np.flatnonzero(~flags).tolist()]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["spans"].append([{"start": i, "end": j} for i, j in gone])
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(out["kept"], pa.string())], ["doc_id", *out])

    return joined.mapInArrow(make, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM t WHERE len(w) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM s),
d AS (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN d USING (g))),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS kept, len(w) AS n_words, coalesce(n, 0) AS n_removed
      FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
