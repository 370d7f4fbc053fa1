"""LM scoring by Katz backoff over words.

Tokens are the words of a lower-cased (A-Z) text and one end; the first word's history is the start. With c the counts
in training tokens and d the Good-Turing discount of the counts 1 to LOW (1 for larger ones),
    P(w | h) = d c(h w) / c(h)     where h w was seen (with c(h) + 1 where no follower of h has a discounted count),
    P(w | h) = alpha(h) P(w)       where it wasn't; alpha(h) makes the sum over all w exactly 1,
    P(w) = d c(w) / N scaled, and one unknown word has the mass that discounting set free.
A history never seen has alpha 1. Words and pairs are told apart by 64-bit hashes.

Counts are pre-summed over batches of TOKENS tokens, so the most frequent word or pair is one entry a batch; batches
meet in tables partitioned by ranges of the hash, which spread any key evenly:
    ask       each batch sends its distinct words and pairs, with its own training counts, to the tables;
    answer    a table sums each entry and answers each batch in the order it was asked: what the others counted, and
              whether the batch is the first to have it (so that sums over types take each type once);
    evaluate  a batch evaluates its tokens, recursively: pair, else unigram, else unknown. What needs sums over all
              followers of a history goes to the tables of histories: this batch's share of the sums, and a question
              for alpha where a token of the batch backs off;
    back off  the tables of histories answer, and batches add up what their texts backed off by.
Entries travel as compressed blocks of sorted hashes, one for each batch and table; a table has the entries of about
CHARS characters however large the input is. No count, hash or history is gathered on the driver but the LOW + 1 first
counts of counts and the totals.

Null text is empty: one token, the end. Null doc_ids are in the training part. Repeated rows count as often as they
occur. With no training text all tokens are unknown: P is 1 for each, and the base is that of the formula. Empty docs
give no rows. A text is one batch at least, in memory at about 150 bytes a word. Only doc_id and text are read; docs
must be a table scan (the same rows in the same order if read again).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, hashes, materialize, mix, signed, slices, table

#: Tokens of a batch, characters for each partition of the tables, counts that are discounted.
TOKENS, CHARS, LOW = 1_500_000, 8_000_000, 5
START, END = np.uint64(0x5EED0001), np.uint64(0x5EED0002)
SCORES = "doc_id long, held boolean, n_tokens long, n_known long, base double, logs double"


def tokens(text: str | None) -> np.ndarray:
    return np.append(hashes((text or "").encode().lower().split()), END)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts of the counts 1 to LOW from n[r - 1], the number of types with count r, r up to LOW + 1.
    Where they give none between 0 and 1, half a count is taken off."""
    first = (LOW + 1) * n[LOW] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, LOW + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - first) / (1 - first) if n[r - 1] and first < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """P(w) from counts: total tokens, types with each low count."""

    def __init__(self, total: int, types: list[int]):
        self.d = np.array([1.0, *discounts(types)])
        kept = total - sum((1 - self.d[r]) * r * types[r - 1] for r in range(1, LOW + 1))
        self.unknown = max(1 - kept / total, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) / kept if total else 0.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c <= LOW, c, 0)] * c * self.scale, self.unknown)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes, compressed."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        out.append(a.dtype.itemsize.to_bytes(1, "little") + len(a).to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 1
    for _ in range(data[0]):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        at += 9
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(f"<u{width}").ravel())
        at += width * n
    return out


def least_type(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def gaps(ordered: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes; np.cumsum undoes it."""
    return np.diff(ordered, prepend=np.uint64(0))


def parts_of(ordered: np.ndarray, parts: int) -> np.ndarray:
    """Where the range of each of `parts` tables begins in sorted hashes, and the end."""
    return np.searchsorted((ordered >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


class Batch:
    """Tokens of some texts: w and h (word and history of each), its words uw and pairs up, sorted, and where tokens are in them."""

    def __init__(self, w: np.ndarray, n: np.ndarray):
        self.n, first = n, np.cumsum(n) - n
        self.uw, self.wi = np.unique(w, return_inverse=True)
        h = np.concatenate([[START], w[:-1]])
        h[first] = START
        self.up, self.at, self.pi = np.unique(mix(mix(h) + w), return_index=True, return_inverse=True)
        self.hi = np.concatenate([[len(self.uw)], self.wi[:-1]])  # a history is its word's place, the start is behind the last
        self.hi[first] = len(self.uw)

    def own(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of uw and up; held: of each text."""
        train = np.repeat(~held, self.n)
        return np.bincount(self.wi[train], minlength=len(self.uw)), np.bincount(self.pi[train], minlength=len(self.up))


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
    """number, doc_ids, held, tokens of each text and all tokens of each batch of this task."""
    number, size = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []

    def done() -> tuple:
        return number, [x[0] for x in held], np.array([x[1] for x in held], bool), np.array([len(x[2]) for x in held]), np.concatenate([x[2] for x in held])

    for b in slices(batches, "text"):
        for d, t, out_of in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.append((d, bool(out_of), tokens(t)))
            size += len(held[-1][2])
            if size > TOKENS:
                yield done()
                held, size, number = [], 0, number + 1
    if held:
        yield done()


def blob_rows(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        some = rows[i : i + 64]
        yield pa.record_batch({"batch": pa.array([number] * len(some), pa.int64()), "part": pa.array([x[0] for x in some], pa.int64()), "blob": pa.array([x[1] for x in some], pa.binary())})


BLOBS = "batch long, part long, blob binary"


def asked(rows: DataFrame, parts: int) -> DataFrame:
    """A block for each batch and table: its words and pairs there, and its training counts of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, held, n, w in batches_of(batches):
            b = Batch(w, n)
            cw, cp = b.own(held)
            ww, pp = parts_of(b.uw, parts), parts_of(b.up, parts)
            yield from blob_rows(number, [(p, pack(gaps(b.uw[i:j]), least_type(cw[i:j]), gaps(b.up[k:m]), least_type(cp[k:m]))) for p, (i, j, k, m) in enumerate(zip(ww, ww[1:], pp, pp[1:])) if j > i or m > k])

    return rows.mapInArrow(make, BLOBS)


def answers(keys: list[np.ndarray], own: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each block the counts of others, twice, plus 1 where the block is the first to have counted the key; and all counts."""
    key, n = np.concatenate(keys), np.concatenate(own).astype(np.int64)
    uk, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, n, minlength=len(uk)).astype(np.int64)
    first = np.zeros(len(key), np.int64)
    counted = np.flatnonzero(n)
    first[counted[np.unique(inverse[counted], return_index=True)[1]]] = 1
    said = (total[inverse] - n) * 2 + first
    return np.split(said, np.cumsum([len(k) for k in keys])[:-1]), total


def answered(cells: DataFrame) -> DataFrame:
    """Answers to the blocks (batch, part, blob), and a row a table with batch -1 and figures: of words, and of pairs, the
    numbers of types with counts 1 to LOW + 1, of all types and of all tokens."""

    def make(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        blocks = [unpack(x) for x in group.column("blob").to_pylist()]
        said, figures = [], []
        for k in (0, 2):
            some, total = answers([np.cumsum(x[k], dtype=np.uint64) for x in blocks], [x[k + 1] for x in blocks])
            said.append(some)
            figures += [*(int((total == r).sum()) for r in range(1, LOW + 2)), int((total > 0).sum()), int(total.sum())]
        blobs = [pack(least_type(w), least_type(p)) for w, p in zip(*said)]
        part = key[0].as_py()
        return pa.table({
            "batch": pa.array([*group.column("batch").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(blobs) + 1), pa.int64()),
            "blob": pa.array([*blobs, None], pa.binary()), "figures": pa.array([None] * len(blobs) + [figures], pa.list_(pa.int64())),
        })

    return cells.groupBy("part").applyInArrow(make, BLOBS + ", figures array<long>")


def batch_tables(rows: DataFrame) -> DataFrame:
    """Each batch's own tokens, to be met with what it is answered."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, held, n, w in batches_of(batches):
            uw, wi = np.unique(w, return_inverse=True)
            none = np.array([d is None for d in ids], np.uint8)
            yield from blob_rows(number, [(0, pack(gaps(uw), least_type(wi), n.astype("<u4"), np.array([d or 0 for d in ids], np.int64).view(np.uint64), none, held.astype(np.uint8)))])

    return rows.mapInArrow(make, BLOBS)


def joined(group: pa.Table) -> list[np.ndarray]:
    """The arrays of a group's blobs, put together in the order of their parts."""
    return [np.concatenate(x) for x in zip(*(unpack(b) for b in group.sort_by("part").column("blob").to_pylist()))]


def evaluated(own: DataFrame, said: DataFrame, parts: int, unigrams: Unigrams, d: list[float]) -> DataFrame:
    """Of each batch, with part -1, what its texts have without backing off; with a part, its shares and questions there."""
    keep = np.array([1.0, *d])

    def make(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        uw, wi, n, ids, none, held = unpack(left.column("blob")[0].as_py())
        b = Batch(np.cumsum(uw, dtype=np.uint64)[wi], n.astype(np.int64))
        own_w, own_p = b.own(held.astype(bool))
        said_w, said_p = (x.astype(np.int64) for x in joined(right))
        c_w, c_p, first = own_w + said_w // 2, own_p + said_p // 2, said_p % 2 == 1
        starts = c_w[np.searchsorted(b.uw, END)]  # as many starts as ends
        c_h = np.append(c_w, starts)
        p_w = unigrams(c_w)
        kept = np.where(c_p > LOW, c_p, keep[np.minimum(c_p, LOW)] * c_p)
        h_of, w_of = b.hi[b.at], b.wi[b.at]
        doc = np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(doc, x, minlength=len(n))
        seen = c_p > 0
        value = np.where(seen, np.log10(np.where(seen, kept, 1.0)) - np.log10(np.maximum(c_h[h_of], 1)), np.log10(p_w)[w_of])
        backs = ~seen & (c_h[h_of] > 0)
        # Where no follower known here has a discounted count, the table of the history has to say whether any has.
        low_here = np.bincount(h_of, (c_p > 0) & (c_p <= LOW), minlength=len(c_h)) > 0
        unsure = seen & ~low_here[h_of]
        asks = np.bincount(h_of, backs | unsure, minlength=len(c_h)) > 0
        share = lambda x: np.bincount(h_of[first], x[first], minlength=len(c_h))
        lows, keeps, masses = share(c_p <= LOW), share(kept), share(p_w[w_of])
        hash_of = np.append(b.uw, START)
        order = np.argsort(hash_of, kind="stable")
        order = order[(asks | (keeps > 0))[order]]
        rank = np.full(len(c_h), -1)
        rank[order[asks[order]]] = np.arange(int(asks.sum()))
        place, times = np.unique(np.stack([doc, rank[b.hi], unsure[b.pi]])[:, (backs | unsure)[b.pi]], axis=1, return_counts=True) if (backs | unsure).any() else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
        texts = pack(ids, none, held, n, least_type(add(c_w[b.wi] > 0).astype(np.int64)), add(np.log10(c_w + 1.0)[b.wi]).view("<u8"), add(value[b.pi]).view("<u8"), *(least_type(x) for x in (*place, times)))
        cut = parts_of(hash_of[order], parts)
        out = [(-1, texts)]
        for p, (i, j) in enumerate(zip(cut, cut[1:])):
            if j > i:
                at = order[i:j]
                out.append((p, pack(gaps(hash_of[at]), keeps[at].view("<u8"), masses[at].view("<u8"), least_type(lows[at].astype(np.int64)), asks[at].astype(np.uint8), least_type(c_h[at[asks[at]]]))))
        return pa.table({"batch": pa.array([key[0].as_py()] * len(out), pa.int64()), "part": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})

    return own.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(make, BLOBS)


def backed_off(shares: DataFrame) -> DataFrame:
    """For each question in shares' blobs, in order: log10 of alpha, and of the part that a history without discounted followers keeps."""

    def make(key: tuple, group: pa.Table) -> pa.Table:
        blocks = [unpack(x) for x in group.column("blob").to_pylist()]
        h = [np.cumsum(x[0], dtype=np.uint64) for x in blocks]
        uh, inverse = np.unique(np.concatenate(h), return_inverse=True)
        whole = lambda i, kind: np.bincount(inverse, np.concatenate([x[i].view(kind) for x in blocks]), minlength=len(uh))
        kept, mass, low = whole(1, "<f8"), whole(2, "<f8"), np.bincount(inverse, np.concatenate([x[3] for x in blocks]), minlength=len(uh))
        blobs = []
        for x, at in zip(blocks, np.split(inverse, np.cumsum([len(x) for x in h])[:-1])):
            at = at[x[4].astype(bool)]
            c = x[5].astype(np.float64)
            more = low[at] == 0
            free = np.where(more, c + 1, c) - kept[at]
            blobs.append(pack((np.log10(free) - np.log10(c + more) - np.log10(1 - mass[at])).view("<u8"), np.where(more, np.log10(c) - np.log10(c + 1), 0.0).view("<u8")))
        return pa.table({"batch": group.column("batch"), "part": group.column("part"), "blob": pa.array(blobs, pa.binary())})

    return shares.groupBy("part").applyInArrow(make, BLOBS)


def summed(texts: DataFrame, said: DataFrame) -> DataFrame:
    def make(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, none, held, n, known, base, logs, doc, rank, unsure, times = unpack(left.column("blob")[0].as_py())
        logs = logs.view("<f8").copy()
        if len(doc):
            alpha, less = (x.view("<f8") for x in joined(right))
            logs += np.bincount(doc, np.where(unsure == 1, less[rank], alpha[rank]) * times, minlength=len(n))
        return pa.table({
            "doc_id": pa.array(ids.view(np.int64), mask=none.astype(bool)), "held": pa.array(held.astype(bool)), "n_tokens": pa.array(n.astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)), "base": pa.array(base.view("<f8")), "logs": pa.array(logs),
        })

    return texts.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(make, SCORES)


def katz(docs: DataFrame, held: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(4, -(-chars // CHARS))
    said = materialize(answered(asked(rows, parts)))
    figures = said.where("batch < 0").agg(*[F.sum(F.get("figures", F.lit(i))) for i in range(2 * (LOW + 3))]).first()
    of_words, of_pairs = ([x or 0 for x in part] for part in (figures[: LOW + 3], figures[LOW + 3 :]))
    distinct, total = of_words[-2:]
    found = materialize(evaluated(batch_tables(rows), said.where("batch >= 0"), parts, Unigrams(total, of_words), discounts(of_pairs)))
    done = summed(found.where("part < 0"), backed_off(found.where("part >= 0")))
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return done.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("logs").alias("score"))


def op10_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
