"""Maximal runs of words with a small period, by minimizers of several scales, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q, at least LEAST words and TIMES periods long, that no
neighbouring word extends with the same period. Periods up to SHORT are scanned directly: all words are compared with
those q places on. Each scale k = 2, 4, 8 ... times SHORT covers the periods from over k / 2 to k. Its grams are k words long, and its
windows hold k / 2 places, fewer than the period; a place is kept if its gram has the smallest hash of some window. A run
has room for a window and the same window one period on, so a kept place is kept again at period distance, and as a gram is no shorter
than the period, two equal grams inside a run are never nearer than that. So consecutive kept places with equal grams
give the period itself; each such pair seeds a comparison of the words to both sides. Grams are hashes, but the
runs come from comparing words, so hashes that collide cost time and change nothing.

Texts of a batch are laid one behind another with a word between them that stands nowhere else, longest first, so
a scale leaves out the texts too short for it. Every text is one row, nothing is shuffled; a batch holds about 4 MB of text, and a
longer text is alone, held whole by its task (about 100 bytes a word).

Words are compared as they are. A null or empty text has no words and no runs; repeated rows and ids each have
their result; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import flag_array, mix, slices, table

#: Words and periods of a run at least, and the longest period that is scanned directly.
LEAST, TIMES, SHORT = 6, 4, 4
WORD = r"[^\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def primitive(x: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the 2 * q words from start, which have period q."""
    n, r, left = 2 * q, 2, q
    while left > 1:
        if left % r:
            r = r + 1 if r * r <= left else left
            continue
        while left % r == 0:
            left //= r
        d = q // r
        if (x[start : start + n - d] == x[start + d : start + n]).all():
            return False
    return True


def scanned(x: np.ndarray, q: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of period q, by one comparison of all words."""
    same = np.concatenate([[False], x[:-q] == x[q:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first + q >= max(LEAST, TIMES * q)
    for i, j in zip(first[long].tolist(), last[long].tolist()):
        yield i, j - i + q, q


def over(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of each width neighbours from a place on; width is a power of two."""
    step = 1
    while step < width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def extended(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The first place and the end of the places i around `at` with x[i] == x[i + q]."""
    end, step = at, 64
    while end < len(x) - q:
        stop = min(end + step, len(x) - q)
        odd = np.flatnonzero(x[end:stop] != x[end + q : stop + q])
        if len(odd):
            end += int(odd[0])
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start > 0:
        stop = max(start - step, 0)
        odd = np.flatnonzero(x[stop:start] != x[stop + q : start + q])
        if len(odd):
            start = stop + int(odd[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def seeded(x: np.ndarray, grams: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of periods over k / 2 and up to k from pairs of equal minimizers."""
    width = k // 2
    if len(grams) < width:
        return
    least = over(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    kept = np.flatnonzero(over(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    kept = kept[np.lexsort((kept, grams[kept]))]
    gap = np.diff(kept)
    pair = np.flatnonzero((grams[kept[1:]] == grams[kept[:-1]]) & (gap > width) & (gap <= k))
    by_period: dict[int, list[int]] = defaultdict(list)
    for at, q in sorted(zip(kept[pair].tolist(), gap[pair].tolist())):
        by_period[q].append(at)
    for q, places in by_period.items():
        i = 0
        while i < len(places):
            if x[places[i]] != x[places[i] + q]:  # the hashes collided
                i += 1
                continue
            start, end = extended(x, places[i], q)
            if end - start + q >= max(LEAST, TIMES * q):
                yield start, end - start + q, q
            i = bisect_left(places, end, i)


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, given as the numbers of its words, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.concatenate([part for k, i in enumerate(order) for part in (texts[i], [-1 - k])] or [np.empty(0)]).astype(np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def fits(q: int) -> np.ndarray:
        """The words of the texts long enough for a run of period q."""
        return x[: begin[int(np.searchsorted(-size, -max(LEAST, TIMES * q), "right"))]]

    def stretches() -> Iterator[tuple[int, int, int]]:
        for q in range(1, SHORT + 1):
            if len(part := fits(q)):
                yield from scanned(part, q)
        grams, length, k = mix(fits(SHORT + 1).view(np.uint64)), 1, 2 * SHORT
        while len(part := fits(k // 2 + 1)):
            while length < k:
                grams = mix(grams[: len(part)][:-length] * np.uint64(0x9E3779B97F4A7C15) + grams[: len(part)][length:])
                length *= 2
            yield from seeded(part, grams, k)
            k *= 2

    for start, length, q in stretches():
        if q == 1 or primitive(x, start, q):
            k = int(np.searchsorted(begin, start, "right")) - 1
            found[order[k]].append((start - int(begin[k]), length, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period of each, by start, then period) and collapsed: the
    words that no run holds after its first period, joined by one space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            number = defaultdict(count().__next__)
            found = runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
            kept = []
            for w, f in zip(words, found):
                if f:
                    gone = flag_array(len(w), np.array([s + q for s, _, q in f]), np.array([s + n for s, n, _ in f]))
                    w = [w[i] for i in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(w).decode())
            each = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.record_batch({"doc_id": b.column(0), "runs": pa.array(each, kind), "collapsed": pa.array(kept, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {dict(docs.dtypes)['doc_id']}, runs array<{RUN}>, collapsed string")


def repeating(doc_id: Column, text: Column) -> Column:
    """text; of a tenth of the ids, by crc32, with the words from some place on replaced by repeats of the first of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & text.rlike(WORD), made).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the most periods, the first and shortest of equal ones; null without runs."""
    more = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    return F.reduce(runs, F.lit(None).cast(RUN), lambda a, b: F.when(a.isNull() | more(a, b), b).otherwise(a))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(F.col("r.length") * 1000 / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
