"""Similarity join of sets of word shingles by T-occurrence search with DivideSkip, and the groups that its links make.

Two documents link when 100 * common >= PERCENT * all of their shingles, so the sets a and b long need
ceil(PERCENT * (a + b) / (100 + PERCENT)) in common, and differ in at most D = (100 - PERCENT) * (a + b) / (100 + PERCENT).

Blocks. Sizes are cut into classes; in a class of sizes up to h, hashes are cut into ranges, K = D at 2 * h, one, and a
margin more. Each differing shingle spoils one range at most, so two sets that link hold the same shingles in more ranges than
the margin. A range is weak for a set that has nothing in it but frequent shingles. A set with no more weak ranges than the margin gives
the hashes of the others; any other set gives all, as then its partner has as many weak ones and gives all too. So any two sets that link
give one hash in common. All sets that give a hash are in the block of the smallest of them, and a block is searched as a whole: no link is lost. What is
frequent comes from a sketch of counters over all documents; it decides how large blocks get, never what links.

Search. A set links only if PERCENT of its shingles stand in other sets of the block too, so sets below that leave it, and others may
then fall below. The rest has an inverted list for each shingle that two of its sets hold. For a set that must share T shingles, the L longest of its
lists are set aside (DivideSkip's L); documents that stand T - L times in the short ones are found by a heap over them, which
skips in all lists what can't come to that number, and probed for the long ones' shingles by binary search. The sum is the exact overlap. Of
documents that are linked with each other already, one link is enough: the others leave the lists, as do those that share too little with all
others for a set of this size.

A block of more than MEMBERS sets or SHINGLES shingles is cut into parts, its first set in each. If links then join the
whole block, as they do for a group of near copies, it is done; else the sets outside its largest group search all parts.
That is exact at any size; its work is the number of such sets times the block.

Shingles are 64-bit hashes, made from the XXH64 of their words; sets are told apart by 128 bits. Null and empty texts have an empty set and link with nothing. Equal
sets are one node, so copies cost nothing. Repeated rows and ids are kept, each has its result; a null doc_id isn't the smallest of a group
unless all are null; an empty table gives no rows. A very long text is held whole by its task (about 100 bytes a word). Only doc_id and text are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, materialize, mix, salted_join, signed, slices, table
from .graph import components

WIDTH, PERCENT = 4, 85
#: Counters of the sketch, its slices, and the share of documents that makes a shingle frequent.
COUNTERS, SLICES, FREQUENT = 1 << 20, 16, 256
#: Sets and shingles of a part of a block, and DivideSkip's weight of a probe.
MEMBERS, SHINGLES, PROBE = 2_000, 2_000_000, 0.0085


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of width words, each made from those of its words; of the whole text if it has fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each, k = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(width, len(words))
    made = np.full(len(words) - k + 1, k, np.uint64)
    for i, by in enumerate(mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)):
        made += each[i : i + len(made)] * by
    made = np.sort(mix(made))
    return made[np.concatenate([[True], made[1:] != made[:-1]])]


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    return [shingle_set(t, width) for t in texts]


def counter_of(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Whether the shingles of each counter are frequent: COUNTERS bits, from the counts of all documents."""
    size = COUNTERS // SLICES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(COUNTERS, np.int64), 0
        for b in slices(batches, "text"):
            sets = sets_of(b.column(0).to_pylist(), width)
            counts += np.bincount(counter_of(np.concatenate(sets)), minlength=COUNTERS)
            rows += sum(len(x) > 0 for x in sets)
        yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([x.astype(np.int32).tobytes() for x in counts.reshape(SLICES, size)]), "rows": pa.array([rows] * SLICES, pa.int64())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for b in batches:
            for k, c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
                rows[k] = rows.get(k, 0) + n
        if sums:
            yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()]), "rows": pa.array([rows[k] for k in sums], pa.int64())})

    kind = "slice int, counts binary, rows long"
    made = docs.select("text").mapInArrow(tally, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()  # SLICES rows, 8 MB in all
    counts = np.zeros((SLICES, size), np.int64)
    for r in made:
        counts[r.slice] = np.frombuffer(r.counts, np.int64)
    rows = max((r.rows for r in made), default=0)
    return np.packbits(counts.reshape(-1) > max(8, counts.sum() // COUNTERS + rows // FREQUENT))


@lru_cache(None)
def size_classes(most: int, percent: int) -> list[tuple[int, int]]:
    """(largest size, differing shingles of a link at most) of the classes of sizes up to most."""
    differ = lambda h: 2 * h * (100 - percent) // (100 + percent)
    h = 1
    while not differ(h + 1):  # such sets link only if they are equal
        h += 1
    out = [(h, 0)]
    while out[-1][0] < most:
        h = out[-1][0] + max(1, out[-1][0] // 2)
        out.append((h, differ(h)))
    return out


@lru_cache(None)
def cuts(h: int, differ: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where ranges begin but for the first, a mark of each range, and the margin, in the class of sizes up to h."""
    margin = (differ + 1) // 8 + 1
    n = differ + 1 + margin
    return np.arange(1, n, dtype=np.uint64) * np.uint64(2**64 // n), mix(np.arange(n, dtype=np.uint64) + np.uint64(h << 32)), margin


def signatures(x: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which any two sets that link and aren't equal have one in common; x is sorted."""
    a, out = len(x), []
    most = a * 100 // percent
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    rare = np.concatenate([[0], np.cumsum(~frequent[counter_of(x)])])
    low = 0
    for h, differ in size_classes(max(1, most), percent):
        if differ and a <= h and most > low:
            begin, mark, margin = cuts(h, differ)
            edge = np.concatenate([[0], np.searchsorted(x, begin), [a]])
            weak = rare[edge[1:]] == rare[edge[:-1]]
            each = mix(sums[edge[1:]] - sums[edge[:-1]] + mark)
            out.append(each if weak.sum() > margin else each[~weak])
        low = h
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketches(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n (shingles), key (names the set), node (its first 8 bytes) and signatures of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(frequent).astype(bool)
        for b in slices(batches, "text"):
            sets = sets_of(b.column(1).to_pylist(), width)
            key = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            made = {"doc_id": b.column(0), "mark": b.column(2), "n": pa.array([len(x) for x in sets], pa.int64()), "key": pa.array(key, pa.binary()), "node": pa.array([int.from_bytes(k[:8], "little", signed=True) for k in key], pa.int64())}
            yield pa.record_batch(made | {"signatures": pa.array([signed(signatures(x, flags, percent)) for x in sets], pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(make, "doc_id long, mark long, n long, key binary, node long, signatures array<long>")


def stars(made: DataFrame) -> DataFrame:
    """leader, node: the sets of each block, but for the leader itself. Each node once a block."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None
        for b in batches:
            if not b.num_rows:
                continue
            s, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[s[0] != last], s[1:] != s[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            heads = node[begin]
            if not new[0]:
                heads[: int(np.argmax(new)) if new.any() else len(s)] = leader
            last, leader = s[-1], heads[-1]
            out = heads != node
            pairs = np.unique(np.stack([heads[out], node[out]], axis=1), axis=0)
            yield pa.record_batch({"leader": pa.array(pairs[:, 0]), "node": pa.array(pairs[:, 1])})

    each = made.select("node", F.explode("signatures").alias("s")).select("s", "node")
    return each.repartition("s").sortWithinPartitions("s", "node").mapInArrow(first, "leader long, node long").distinct()


def occurring(lists: Sequence[Sequence[int]], least: int, more: Callable[[int], int] | None = None) -> Iterator[tuple[int, int]]:
    """Numbers that stand in at least so many of the sorted lists, in order, and in how many.

    more(number), if given, is how many lists that number has to stand in; it doesn't fall from one number to the next, and takes the place of least.
    A heap holds the next number of each list. If what is at its top stands there too seldom, the next numbers are taken too until they
    come from least - 1 lists: nothing below the new top can come to least, so these lists skip to it."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if len(x)]
    heapify(heap)
    while len(heap) >= least:
        top, taken = heap[0][0], []
        if more:
            least = more(top)
        while heap and heap[0][0] == top:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            yield top, len(taken)
            for k in taken:
                at[k] += 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heappop(heap)[1])
            if not heap:
                return
            for k in taken:
                at[k] = bisect_left(lists[k], heap[0][0], at[k])
        for k in taken:
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


def links(sets: list[np.ndarray], ask: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of indexes that link, of which one is asked for; of those joined by other pairs already, not all."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    while True:  # until hardly any leave
        n, owner = len(order), np.repeat(np.arange(len(order)), size[order])
        token, held = np.unique(np.concatenate([*(sets[i] for i in order), np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)[1:]
        shared = np.bincount(owner[held[token] > 1], minlength=n)
        order = order[(stays := 100 * shared >= percent * size[order])]
        if 8 * len(order) >= 7 * n:
            break
    # From here on sets go by their place in the order, and shingles that no other set holds are left out.
    kept = stays[owner] & (held[token] > 1)
    m, size, shared, token = len(order), size[order], shared[stays], token[kept]
    able = (100 + percent) * shared - percent * size  # percent times the size of the largest set that a set may link with
    post = np.sort(token * m + np.repeat(np.arange(m), shared))  # inverted lists, one behind another
    holder = post % m
    start = np.concatenate([[0], np.cumsum(shared)])
    root, found, everyone, sized = np.arange(m), [], bool(ask.all()), size.tolist()
    for s in np.flatnonzero(ask[order]).tolist():
        a = int(size[s])
        low = int(np.searchsorted(size, -(-percent * a // 100)))
        high = min(s if everyone else m, int(np.searchsorted(size, min(a * 100, int(able[s])) // percent, "right")))
        mine = token[start[s] : start[s + 1]] * m
        while (fit := (root[low:high] != root[s]) & (able[low:high] >= percent * a)).any():
            need = -(-percent * (a + int(size[low])) // (100 + percent))
            begin, end = np.searchsorted(post, mine + low), np.searchsorted(post, mine + high)
            some = np.flatnonzero(end > begin)
            if len(some) < need:
                break
            some = some[np.argsort(begin[some] - end[some], kind="stable")]  # the longest first
            longest = int(end[some[0]] - begin[some[0]])
            aside = min(need - 1, int(need / (PROBE * math.log2(longest) + 1)))
            probed, short = np.sort(mine[some[:aside]] // m), some[aside:]
            lists = memoryview(holder)
            spans = list(zip(begin[short].tolist(), end[short].tolist()))
            if not fit.all():  # what is joined with s already, or shares too little with all others, leaves the lists
                length = end[short] - begin[short]
                places = np.repeat(begin[short] - np.cumsum(length) + length, length) + np.arange(length.sum())
                left = holder[places]
                stays = fit[left - low]
                edge = np.concatenate([[0], np.cumsum(np.add.reduceat(stays, np.cumsum(length) - length) if len(length) else [])]).astype(np.int64)
                lists, spans = memoryview(left[stays]), list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            # A larger set must share more, so the lists skip further the larger the sets get.
            for other, n in occurring([lists[i:j] for i, j in spans], need - aside, lambda other: -(-percent * (a + sized[other]) // (100 + percent)) - aside):  # noqa: B023
                held = token[start[other] : start[other + 1]]  # as sorted as a list, and shorter than most
                at = np.minimum(held.searchsorted(probed), len(held) - 1)
                if (100 + percent) * (n + np.count_nonzero(held[at] == probed)) >= percent * (a + sized[other]):
                    found.append((int(order[s]), int(order[other])))
                    root[root == root[other]] = root[s]
                    low = other + 1
                    break
            else:
                break
    return found


def named(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("name")


def searched(blocks: DataFrame, docs: DataFrame, by: list[str], width: int, percent: int) -> DataFrame:
    """Links (a, b, keys) in the blocks (key, name, mark, ask) that `by` names."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].tolist()
        found = links(sets_of(pdf["text"].tolist(), width), pdf["ask"].to_numpy(bool), percent)
        return pd.DataFrame([(key[i], key[j]) for i, j in found], columns=["a", "b"])

    texts = blocks.join(docs.select(named(F.col("doc_id")), F.xxhash64("text").alias("mark"), "text"), ["name", "mark"])
    once = texts.repartition(*by).groupBy(*by, "key").agg(F.first("text").alias("text"), F.max("ask").alias("ask"))  # rows may be repeated
    return once.groupBy(*by).applyInPandas(search, "a binary, b binary")


def part_of(total: Column, shingles_of: Column) -> Column:
    return F.greatest(F.ceil(total / MEMBERS), F.ceil(shingles_of / SHINGLES), F.lit(1))


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows (leader, node, n) and in `name` how many parts each block is to have."""
    sums = rows.groupBy("leader").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("n")).select("leader", part_of(F.col("n"), F.col("all")).alias(name), "n")
    return salted_join(rows.withColumnRenamed("n", "shingles"), sums, ["leader"], "node", rows.count()).withColumnRenamed("shingles", "n")


def every(parts: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), parts - 1)


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b, keys of nodes) whose groups are those of all links in the blocks (leader, node)."""
    members = pairs.unionByName(pairs.select("leader", F.col("leader").alias("node")).distinct())
    rows = materialize(members.join(nodes.select("node", "key", "name", "mark", "n"), "node").select("leader", "node", "key", "name", "mark", "n"))
    sized = materialize(dealt(rows, "pieces").withColumn("part", F.pmod(F.xxhash64("node"), F.col("pieces"))))
    own = F.when(F.col("node") == F.col("leader"), every(F.col("pieces"))).otherwise(F.array("part"))
    found = materialize(searched(sized.select("leader", "key", "name", "mark", F.lit(True).alias("ask"), F.explode(own).alias("part")), docs, ["leader", "part"], width, percent))
    large = sized.where("pieces > 1")
    if large.isEmpty():
        return found
    joined = components(found).select(F.col("node").alias("key"), "root")
    rooted = materialize(large.join(joined, "key", "left").withColumn("root", F.coalesce("root", "key")))
    top = rooted.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).select("leader", F.col("top.root").alias("most"), "n")
    outside = materialize(salted_join(rooted.withColumnRenamed("n", "shingles"), top, ["leader"], "node", rooted.count()).where("root <> most").withColumnRenamed("shingles", "n").drop("most", "root"))
    if outside.isEmpty():
        return found
    asking = materialize(dealt(outside, "askers").withColumn("asker", F.pmod(F.xxhash64("node"), F.col("askers"))))
    counts = asking.groupBy("leader").agg(F.max("askers").alias("askers"))
    asked = large.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).join(counts, "leader")
    base = salted_join(large.drop("n"), asked, ["leader"], "node", rooted.count()).select("leader", "key", "name", "mark", F.lit(False).alias("ask"), "part", F.explode(every(F.col("askers"))).alias("asker"))
    queries = asking.select("leader", "key", "name", "mark", F.lit(True).alias("ask"), F.explode(every(F.col("pieces"))).alias("part"), "asker")
    return found.unionByName(materialize(searched(base.unionByName(queries), docs, ["leader", "part", "asker"], width, percent)))


def similarity_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = docs.select("doc_id", "text")
    made = materialize(sketches(docs, sketch(docs, width), width, percent))
    nodes = materialize(made.where("n > 0").groupBy("key", "node").agg(F.min(F.struct(named(F.col("doc_id")), "mark")).alias("best"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")).select("*", "best.*").drop("best"))
    pairs = materialize(stars(made))
    roots = components(similar(docs, nodes, pairs, width, percent)).select(F.col("node").alias("key"), "root")
    rooted = materialize(nodes.join(roots, "key", "left").select("key", "least", "rows", F.coalesce("root", "key").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    grouped = salted_join(rooted, groups, ["root"], "key", rooted.count()).select("key", "component_id", F.col("rows").alias("n"))
    each = made.select("doc_id", "key", F.col("n").alias("n_shingles"), F.monotonically_increasing_id().alias("row"))
    return salted_join(each, grouped, ["key"], "row", made.count(), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n
          GROUP BY i, j, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
reach AS (SELECT doc_id, doc_id AS least FROM s UNION SELECT j, least FROM reach JOIN links ON doc_id = i)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(least) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(g)
"""
