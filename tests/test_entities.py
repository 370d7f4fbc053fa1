"""Mentions and their fuller names against all pairs."""

import random
import re
from itertools import permutations

from sievespark.operators.entities import resolved

KIND = "doc_id long, value string"


def plain(values):
    parts = {v: [p.lower() for p in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", v)] for v in values}
    parts = {v: p for v, p in parts.items() if p}
    fits = lambda a, b: a == b or len(a) == 1 and b.startswith(a)

    def covers(full, short):
        a, b = parts[short], parts[full]
        if not any(len(p) > 1 for p in a) or max(len(a), len(b)) > 4 or len(b) < len(a) or len("".join(b)) <= len("".join(a)):
            return False
        return any(all(fits(p, q) for p, q in zip(a, some)) for some in permutations(b, len(a)))

    above = {v: [w for w in parts if w != v and covers(w, v)] for v in parts}
    out = {}
    for v in parts:
        top = [w for w in above[v] if not above[w]]
        out[v] = top[0] if len(top) == 1 else v
    return out


def test_mentions(spark):
    rows = [(1, v) for v in ("Anna Maria Stone", "Anna Stone", "A. Stone", "Stone", "Anna", "A. M.", "Bob", "Stone, Anna")]
    rows += [(2, v) for v in ("Anna Stone", "Alan Stone", "A. Stone", "Anna", "anna stone")] + [(3, None), (3, "12"), (3, "Solo"), (3, "Solo")]
    got = {(r.doc_id, r.value): r.entity for r in resolved(spark.createDataFrame(rows, KIND)).collect()}
    full = "Anna Maria Stone"
    assert {v: e for (d, v), e in got.items() if d == 1} == {"Anna Maria Stone": full, "Anna Stone": full, "A. Stone": full, "Stone": full, "Anna": full, "A. M.": "A. M.", "Bob": "Bob", "Stone, Anna": full}
    assert got[2, "A. Stone"] == "A. Stone" and got[2, "Alan Stone"] == "Alan Stone" and got[2, "Anna"] == "Anna" and got[3, "Solo"] == "Solo" and len(got) == 14
    assert resolved(spark.createDataFrame(rows, KIND).where("false")).count() == 0


def test_as_all_pairs(spark):
    r = random.Random(5)
    docs = {}
    for d in range(60):
        names = []
        for _ in range(r.randint(1, 12)):
            words = [r.choice(["Ann", "Anna", "Al", "Bo", "Ray", "Stone", "S.", "A.", "B. "]) for _ in range(r.randint(1, 5))]
            names.append(" ".join(words))
        docs[d] = set(names)
    rows = [(d, v) for d, names in docs.items() for v in names]
    got = {(x.doc_id, x.value): x.entity for x in resolved(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert got == {(d, v): e for d, names in docs.items() for v, e in plain(names).items()}
