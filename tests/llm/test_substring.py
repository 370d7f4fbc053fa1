"""Substring dedup against a plain version, over anchors parsed as groups and over windows, and small tiles."""

import random
from collections import Counter

import pytest

from sievespark.llm import substring_dedup as sd


def plain(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def texts_of(seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randint(20, 120))] for _ in range(12)]
    out = [None, "", " \t", "a " * 100, "one word"]
    for k in range(70):
        t = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            i = r.randrange(len(b))
            t += b[i : i + r.randint(5, 90)] + [f"u{k}{r.randrange(99)}" for _ in range(r.randint(0, 9))]
        out.append(r.choice([" ", "\n", "  "]).join(t))
    return out + out[5:20] + [out[30]] * 30


@pytest.mark.parametrize(("width", "many", "tile"), [(12, 256, 1 << 19), (12, 2, 1 << 19), (35, 256, 30), (5, 256, 1 << 19)])
def test_plain(spark, monkeypatch, width, many, tile):
    monkeypatch.setattr(sd, "MANY", many)
    monkeypatch.setattr(sd, "TILE", tile)
    texts = texts_of(width)
    docs = spark.createDataFrame([(i % 90, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row long").repartition(4)
    docs = sd.materialize(docs)  # a table scan
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.substring_dedup(docs, width).collect())
    assert got == sorted((i % 90, *x) for i, x in enumerate(plain(texts, width)))


def test_greedy_factors():
    block = [b"%d" % i for i in range(20)]
    others = [([b"x"] + block[2:9], 4), (block[5:14] + [b"y"], 0), (block[:4], 3)]
    assert sd.parse(block, 5, others, 4) == [(2, 9), (6, 14)]
    assert sd.match(block, 5, block[:8], 5) == (0, 8) and sd.parse(block, 5, [], 4) == []
