"""Quality classifier by positive-unlabelled learning.

A logistic model over hashed byte n-grams and a few shape figures of a text is fitted to trusted positives (label 1)
and unlabelled web text, minimising the non-negative unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with
the sigmoid loss; where the bracket is negative, a step goes back along the bracket's own gradient alone. The class prior pi, the share of positives
among the unlabelled texts, is estimated from these and the positives alone: a plain classifier of labelled against
unlabelled scores the half of the texts that it has not seen, in neither set, and the prior is the least share of unlabelled over that of positives
above a threshold (best bin estimation). Labels 0 are not learned from.

The sample to fit on is bounded: POSITIVES and UNLABELLED different texts on average, those of least hash, each once
however often it stands; it holds no row of the held-out fold. Every whole text is scored; the empty and the null text have the score of a text without
n-grams. Labels, lang, source and doc_id are inputs of no score. With no positives all scores are the prior 0.5.
Repeated rows each have their score, an empty table none; a document is trusted if any of its labels is 1; null labels
count as none. A very long text is counted in tiles of TILE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import broadcast_if_small, fold, mix, slices, table

#: Texts to fit on, hashed features, rounds of full-batch Adam, weight decay.
POSITIVES, UNLABELLED, BUCKETS, ROUNDS, DECAY = 3000, 6000, 1024, 400, 1e-3
SHAPES, TILE = 8, 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams, and shape figures."""
    x = np.zeros(BUCKETS + SHAPES, np.float32)
    data = (text or "").encode()
    if not data:
        return x
    a = np.frombuffer(data, np.uint8)
    for n, at in ((2, 0), (3, BUCKETS // 2)):
        c = np.zeros(BUCKETS // 2, np.int64)
        for first in range(0, len(a) - n + 1, TILE):
            b = a[first : first + TILE + n - 1].astype(np.uint64)
            g = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                g = g << np.uint64(8) | b[i : len(b) - n + 1 + i]
            c += np.bincount((mix(g) % np.uint64(BUCKETS // 2)).astype(np.int64), minlength=BUCKETS // 2)
        if c.any():
            x[at : at + BUCKETS // 2] = np.sqrt(c / c.sum())
    words = data.split()
    upper, lower = int(((a >= 65) & (a <= 90)).sum()), int(((a >= 97) & (a <= 122)).sum())
    marks = int(((a > 32) & (a < 128)).sum()) - upper - lower
    lines = [s for s in data.split(b"\n") if s]
    x[BUCKETS:] = (upper / (1 + upper + lower), marks / len(a), SPACES[a].mean(), len(set(words)) / (1 + len(words)), min(1.0, np.log1p(len(words)) / 10), len(set(lines)) / (1 + len(lines)), min(1.0, len(data) / (1 + len(words)) / 40), 1.0)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def nnpu_step(pos: np.ndarray, unl: np.ndarray, prior: float, w: np.ndarray) -> np.ndarray:
    """What a step goes against: the gradient of the risk, or, where the bracket is negative, minus that of the bracket."""
    sp, su = sigmoid(pos @ w), sigmoid(unl @ w)
    slope = lambda x, s: x.T @ (s * (1 - s)).astype(np.float32) / len(x)  # noqa: E731  gradient of mean sigmoid(z)
    # loss of calling positive: 1 - s; of calling negative: s
    gp, gu = slope(pos, sp), slope(unl, su)
    bracket = gu - prior * gp
    return -prior * gp + bracket if su.mean() >= prior * sp.mean() else -bracket


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk; the bias is then moved so that as many of unl are called positive as the prior says."""
    pos, unl = with_one(pos), with_one(unl)
    w = np.zeros(pos.shape[1])
    adam = Adam(len(w), 0.05)
    for _ in range(rounds):
        w = adam.step(w, nnpu_step(pos, unl, prior, w) + DECAY * w)
    w[-1] -= np.quantile(unl @ w, 1 - prior)  # the share of unl that is called positive is the prior
    return w


def fit_plain(pos: np.ndarray, unl: np.ndarray, rounds: int = 150) -> np.ndarray:
    x = np.hstack([np.vstack([pos, unl]), np.ones((len(pos) + len(unl), 1), np.float32)])
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(unl))])
    w = np.zeros(x.shape[1])
    adam = Adam(len(w), 0.05)
    for _ in range(rounds):
        w = adam.step(w, x.T @ ((sigmoid(x @ w) - y) / len(y)).astype(np.float32) + 1e-3 * w)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unl: with the scores of a classifier on texts that it has not seen, the share of unl above a
    threshold over that of pos, where its upper confidence bound is least (best bin). The first classifier tells labelled from
    unlabelled; the first prior then serves one that minimises the non-negative risk, whose scores give the prior."""
    side = lambda x: np.array([xxhash.xxh3_64_intdigest(row.tobytes()) & 1 for row in x], dtype=bool)  # noqa: E731  a text in both sets is in one half
    p, u = side(pos), side(unl)
    halves = [(pos[p == k], unl[u == k]) for k in (False, True)]
    if any(not len(x) for half in halves for x in half):
        return 0.5
    first = best_bin(fit_plain(*halves[0]), *halves[1])
    return float(np.mean([best_bin(fit_nnpu(*one, first, 200), *two) for one, two in (halves, halves[::-1])]))


def best_bin(w: np.ndarray, pos: np.ndarray, unl: np.ndarray) -> float:
    sp, su = (np.sort(x @ w[:-1] + w[-1]) for x in (pos, unl))
    above = lambda s: 1 - np.searchsorted(s, sp) / len(s)
    bound = sum(np.sqrt(np.log(40) / (2 * len(s))) for s in (sp, su))
    best = np.argmin((above(su) + bound) / above(sp))
    return float(np.clip(above(su)[best] / above(sp)[best], 0.05, 0.95))


def learn(docs: DataFrame, labels: DataFrame, usable) -> np.ndarray | None:
    """Weights of the model; `usable` says which doc_ids may be learned from, in either table."""
    trusted = labels.where(usable & (F.col("quality") == 1)).select("doc_id").distinct()
    rows = docs.select("doc_id", "text").where(usable & F.col("text").isNotNull())
    texts = rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    positives = trusted.count()
    if not positives or not texts:
        return None
    chance = lambda x: F.pmod(x, F.lit(1 << 30)) / (1 << 30)
    trusted = trusted.where(chance(F.xxhash64("doc_id", F.lit(5))) < POSITIVES / positives)
    pos = rows.join(broadcast_if_small(trusted, 4 * POSITIVES), "doc_id").select("text", F.lit(1).alias("y"))
    unl = rows.where(chance(F.xxhash64("text", F.lit(9))) < UNLABELLED / texts).select("text", F.lit(0).alias("y"))
    chosen = pos.unionByName(unl).dropDuplicates(["text", "y"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.record_batch({"y": b.column(1).cast(pa.int32()), "x": pa.array([features(t).astype(np.float16).tobytes() for t in b.column(0).to_pylist()], pa.binary())})

    got = chosen.mapInArrow(make, "y int, x binary").toPandas()  # the bounded sample: about 2 KB a text
    if not len(got):
        return None
    got = got.sort_values(["y", "x"])
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    pos, unl = x[got["y"].to_numpy() == 1], x[got["y"].to_numpy() == 0]
    if not len(pos) or not len(unl):
        return None
    return fit_nnpu(pos, unl, class_prior(pos, unl))


def score(docs: DataFrame, w: np.ndarray | None) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = [0.5 if w is None else float(sigmoid(features(t) @ w[:-1] + w[-1])) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(s, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    scored = score(docs, learn(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
