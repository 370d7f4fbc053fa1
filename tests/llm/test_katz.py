"""Katz backoff against a plain version that shares no code with it, all columns, over several batches and tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sievespark.llm import lm_score

K = 5


def good_turing(types):
    """types[r]: how many types have count r."""
    d, cut = {}, (K + 1) * types[K + 1] / types[1] if types[1] else 1
    for r in range(1, K + 1):
        x = ((r + 1) * types[r + 1] / (r * types[r]) - cut) / (1 - cut) if types[r] and cut < 1 else 0
        d[r] = x if 0 < x < 1 else 1 - 1 / (2 * r)
    return d


class Plain:
    def __init__(self, texts):
        self.c, self.after = Counter(), defaultdict(Counter)
        for t in texts:
            last = "<start>"
            for w in self.words(t):
                self.c[w] += 1
                self.after[last][w] += 1
                last = w
        self.total = sum(self.c.values())
        self.d1 = good_turing(Counter(self.c.values()))
        self.d2 = good_turing(Counter(n for f in self.after.values() for n in f.values()))
        rest = sum(self.d1.get(n, 1) * n for n in self.c.values())
        self.unseen = max(1 - rest / self.total, 1 / (self.total + 1)) if self.total else 1
        self.norm = (1 - self.unseen) / rest if self.total else 0
        self.alpha = {h: self.back(h) for h in self.after}

    @staticmethod
    def words(t):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["<end>"]

    def one(self, w):
        return self.d1.get(self.c[w], 1) * self.c[w] * self.norm if self.c[w] else self.unseen

    def size(self, h):
        f = self.after[h]
        return sum(f.values()) + (min(f.values()) > K)

    def back(self, h):
        f = self.after[h]
        return (1 - sum(self.d2.get(n, 1) * n for n in f.values()) / self.size(h)) / (1 - sum(self.one(w) for w in f))

    def p(self, h, w):
        if h in self.after and w in self.after[h]:
            n = self.after[h][w]
            return self.d2.get(n, 1) * n / self.size(h)
        return self.alpha.get(h, 1) * self.one(w)

    def row(self, t):
        ws = self.words(t)
        base = sum(math.log10((self.c[w] + 1) / (self.total + len(self.c) + 1)) for w in ws)
        return len(ws), sum(self.c[w] > 0 for w in ws), self.total, base, sum(math.log10(self.p(h, w)) for h, w in zip(["<start>", *ws], ws))


def texts_of(seed):
    r, out = random.Random(seed), [None, "", " \n", "One", "one", "É é", "q " * 30]
    for i in range(60):
        out.append("".join(r.choice(["a ", "b ", "c c ", "D ", "lone pair\t", f"w{r.randrange(9)} ", f"x{i} "]) for _ in range(r.randrange(80))))
    return out + ["same text here"] * 40


@pytest.mark.parametrize("small", [False, True])
def test_plain(spark, monkeypatch, small):
    if small:  # many batches and tables
        monkeypatch.setattr(lm_score, "TOKENS", 50)
        monkeypatch.setattr(lm_score, "CHARS", 400)
    texts = texts_of(2)
    docs = spark.createDataFrame([(None if i == 9 else i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, score string, held boolean").repartition(3)
    path = lm_score.materialize(docs)  # a table scan
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 and i != 9 for i in range(len(texts))}
    plain = Plain([t for i, t in enumerate(texts) if not held[i]])
    got = {9 if r.doc_id is None else r.doc_id: r for r in lm_score.katz(path, lm_score.fold(path.doc_id, 4) == 2).collect()}
    assert len(got) == len(texts) and any(held.values())
    for i, t in enumerate(texts):
        n, known, total, base, score = plain.row(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_sums_to_one():
    plain = Plain(texts_of(2))
    for h in plain.after:
        assert math.isclose(sum(plain.p(h, w) for w in plain.c) + plain.alpha[h] * plain.unseen, 1)


def test_none_and_no_training(spark):
    docs = lm_score.materialize(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    assert {(r.score, r.n_known, r.train_tokens, r.base_score) for r in lm_score.katz(docs, docs.doc_id > 0).collect()} == {(0, 0, 0, 0)}
    assert lm_score.katz(docs.where("false"), docs.doc_id > 1).count() == 0
