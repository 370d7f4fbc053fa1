"""Language ID with language-bitmask n-gram filters.

Learning: a bounded sample of the different texts of each language (SAMPLE of them on average, those of least hash, each
once however often it stands) gives the frequencies of its n-grams of bytes of lower-cased text; a language's filter
takes the KEEP most frequent that are not much rarer in it than in another, and occur twice if any does. All filters are one table of SLOTS bitmasks, bit l of a slot being that slot of
language l's Bloom filter: the AND of HASHES slots gives all languages that contain an n-gram at once. The table has
a fixed size for each 64 languages, so it can be broadcast.

Deciding: of a text's n-grams, each language's popcount is corrected for the false positives that the fill of its
filter makes expected; the largest corrected count wins, the first language in order at a tie, and the score is its
share of the n-grams. A text that is null or has no letter is `und`, score 0. A text with letters but no known n-gram
gets the most frequent language of the sample, score 0. Where no language can be learned, all are `und`.
More than LANGUAGES languages are an error. Only doc_id and text (and lang, to learn) are read; each of repeated rows has
its prediction, and an empty table gives none. Very long texts are counted in tiles of TILE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, materialize, mix, slices, table

#: Texts of a language to learn from, n-grams that a filter takes, slots of the table, its hashes, and the lengths of n-grams.
SAMPLE, KEEP, SLOTS, HASHES, LENGTHS = 2000, 20_000, 1 << 20, 3, (3, 4)
#: An n-gram at less than this part of another language's frequency says nothing for a language.
RATIO = 0.2
#: Languages that may be learned, which bounds the table (more are an error), and bytes of a text that are counted at once.
LANGUAGES, TILE = 4096, 1 << 20
LETTER = regex.compile(r"\p{L}")
#: The bits of each byte, the lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def tiles(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, the bytes of its words, each after one space, as numbers; tile by tile, each n-gram in one."""
    data, more = b" " + b" ".join(text.lower().encode().split()) + b" ", max(LENGTHS) - 1
    for at in range(0, max(1, len(data) - more), TILE):
        last = at + TILE >= len(data) - more
        yield grams(data[at:] if last else data[at : at + TILE + more], None if last else TILE)


def grams(data: bytes, most: int | None) -> np.ndarray:
    """The n-grams that begin at the first `most` bytes of data."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = []
    for n in LENGTHS:
        if len(a) >= n:
            g = np.full(len(a) - n + 1, n, np.uint64)
            for i in range(n):
                g = g << np.uint64(8) | a[i : len(a) - n + 1 + i]
            out.append(g[:most])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g)
    return [((h >> np.uint64(21 * i)) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The table of bitmasks, and the rate of false positives of each language."""

    def __init__(self, grams_of: dict[str, np.ndarray], usual: str | None):
        self.languages, self.usual = sorted(grams_of), usual
        self.table = np.zeros((-(-len(self.languages) // 64), SLOTS), "<u8")
        self.false = np.zeros(len(self.languages))
        for i, name in enumerate(self.languages):
            filled = np.zeros(SLOTS, bool)
            for s in slots(grams_of[name]):
                filled[s] = True
            self.table[i // 64, filled] |= np.uint64(1 << i % 64)
            self.false[i] = filled.mean() ** HASHES
        if len(self.languages) <= 8:
            self.table = self.table.astype(np.uint8)

    def counts(self, g: np.ndarray) -> np.ndarray:
        """Popcount of each language over n-grams g."""
        at, found = slots(g), []
        for row in self.table:
            mask = row[at[0]]
            for s in at[1:]:
                mask = mask & row[s]
            for part in mask.view(np.uint8).reshape(-1, mask.itemsize).T:
                found.append(np.bincount(part, minlength=256) @ BITS)  # each value of eight languages' bits is counted, then its bits
        return np.concatenate(found)[: len(self.languages)]

    def decide(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        n, hits = 0, np.zeros(len(self.languages), np.int64)
        for g in tiles(text):
            n, hits = n + len(g), hits + self.counts(g)
        counts = np.maximum(0, (hits - n * self.false) / (1 - self.false))
        best = int(counts.argmax())
        return (self.languages[best], float(min(1.0, counts[best] / n))) if counts[best] > 0 else (self.usual, 0.0)


def learn(docs: DataFrame, usable) -> Filters:
    """Filters of the languages of the rows of docs where `usable` holds."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").alias("language"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("language").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(3))).alias("texts"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not sizes:
        return Filters({}, None)
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE / max(1, n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < part[F.col("language")] * (1 << 30)).dropDuplicates(["language", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in tiles(t):
                    by.setdefault(k, []).append(np.stack(np.unique(g, return_counts=True)))
            for k, parts in by.items():
                every = np.concatenate(parts, axis=1)
                g, where = np.unique(every[0], return_inverse=True)
                n = np.bincount(where, every[1])
                yield pa.record_batch({"language": pa.array([k] * len(g)), "gram": pa.array(g.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = chosen.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    totals = {r[0]: r[1:] for r in counted.groupBy("language").agg(F.sum("n"), F.max("n")).collect()}  # a row a language
    of = lambda i: F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, v[i])])[F.col("language")]
    shares = counted.select("*", (F.col("n") / of(0)).alias("p"), (of(1) > 1).alias("twice"))
    most = shares.groupBy("gram").agg(F.max("p").alias("top"))
    telling = shares.join(most, "gram").where((F.col("p") >= RATIO * F.col("top")) & ((F.col("n") > 1) | ~F.col("twice")))
    # A language's rows here are the n-grams of a bounded sample; the threshold that keeps KEEP of them is one number.
    least = telling.groupBy("language").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select("language", F.coalesce(F.get("ns", F.lit(KEEP)), F.lit(0)).alias("least"))
    kept = telling.join(least, "language").where("n > least").select("language", "gram").toPandas()
    found = {k: kept.loc[kept["language"] == k, "gram"].to_numpy().astype(np.uint64) for k in totals}
    return Filters(found, next(iter(sizes)))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # HASHES, SLOTS and LANGUAGES bound its size: 8 MB for each 64 languages

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "text"):
            found = [own.decide(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    return predict(docs, learn(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of docs, with their columns, that have a known language: not `und`, and a score over 0."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "text"):
            found = [own.decide(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([k != "und" and s > 0 for k, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
