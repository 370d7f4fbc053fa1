"""The pipeline's near duplicates against all pairs of sets of shingles."""

import random

import pytest

import corpus_pipeline
from sievespark.llm import jaccard_join, near


def sets_of(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_survivors(texts, least=0.8):
    sets, root = {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= least * len(a | b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return {i for i in texts if root[i] == i}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


@pytest.fixture
def texts():
    r, out = random.Random(4), [None, "", " \n", "one two", "One  two", "one"]
    license = [f"l{i}" for i in range(40)]
    for k in range(60):
        base = [f"w{r.randrange(300)}" for _ in range(r.randint(30, 200))] + (license if k % 3 else [])
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            base = edited(r, base, r.randint(1, 6))
            out.append(" ".join(base))
    r.shuffle(out)
    return dict(enumerate(out))


def test_survivors_are_those_of_all_pairs(spark, texts, monkeypatch):
    want = plain_survivors(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    assert sorted(r.doc_id for r in near.representatives(docs.union(docs)).collect()) == sorted(want)
    assert near.representatives(docs.where("false")).count() == 0


def test_similar():
    import numpy as np

    from sievespark.llm.simhash import shingles

    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = dict(enumerate(" ".join(edited(r, base, r.randint(0, 7))) for _ in range(80)))
    root = list(range(len(texts)))
    for i, j in jaccard_join.links([np.unique(shingles(t, 5)) for t in texts.values()], np.ones(len(texts), bool), 80):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert {i for i, f in enumerate(root) if i == f} == plain_survivors(texts)


def test_recall_of_planted_pairs(spark):
    """Pairs of 0.8 to 0.9 with nothing else like them: each of them leaves one text."""
    r, rows, want = random.Random(12), [], 0
    for k in range(400):
        words = [f"p{k}w{i}" for i in range(r.randint(60, 300))]
        other = edited(r, words, max(1, round(len(words) * r.uniform(0.01, 0.022))))
        a, b = sets_of(" ".join(words)), sets_of(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
            want += 1
    left = near.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count()
    assert want > 150 and left == len(rows) - want
