"""Similarity join, periodic runs and vector codes against plain versions, and odd inputs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sievespark.llm import jaccard_join, periodic_runs, vector_code

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "ONE"), (5, LONG), (6, LONG + " end"), (7, "a " * 200), (8, "é日 ß"), (9, "x y z x y z x y z x y z")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "k", 1, 2, "extra") for d, t in ODD], "doc_id long, text string, lang string, source string, n long, node long, key string")


def plain_sets(texts, width=4):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
        out.append({" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    return out


def plain_components(rows, percent=85):
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    least = {k: min((d for (d, _), r in zip(rows, root) if r == k and d is not None), default=None) for k in root}
    return sorted((repr(d), len(s), repr(least[r])) for (d, _), s, r in zip(rows, sets, root))


def near_copies(seed, n, words, groups=4):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(r.choice(words))] + (common if g % 2 else [])
        for _ in range(n):
            made = [w if r.random() > r.choice([0, 0.005, 0.02, 0.05]) else f"x{r.randrange(9)}" for w in base]
            rows.append((len(rows) + 10, " ".join(made[r.choice([0, 0, 1, 3]) :])))
    return rows


def test_links_lose_nothing():
    r = random.Random(2)
    hashed = np.random.default_rng(0).integers(0, 2**64, 4000, dtype=np.uint64)

    def groups(n, edges):
        root = list(range(n))
        for i, j in edges:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
        return root

    for trial in range(120):
        base = [r.sample(range(4000), r.randint(1, 120)) for _ in range(4)]
        sets = list({frozenset(t if r.random() > r.choice([0, 0.02, 0.05, 0.1]) else r.randrange(4000) for t in r.choice(base)) for _ in range(r.randint(2, 30))})
        found = [np.unique(hashed[list(s)]) for s in sets]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        ask = np.array([trial % 2 == 0 or r.random() < 0.4 for _ in sets])
        asked = [(i, j) for i, j in want if ask[i] or ask[j]]
        got = [(max(p), min(p)) for p in jaccard_join.links(found, ask, 85)]
        assert set(got) <= set(want) and groups(len(sets), got) == groups(len(sets), asked)
        frequent = np.random.default_rng(trial).random(jaccard_join.COUNTERS) < r.choice([0, 0.3, 0.9, 1])
        given = [set(jaccard_join.signatures(x, frequent, 85).tolist()) for x in found]
        assert all(given[i] & given[j] for i, j in want)


def test_occurring():
    r = random.Random(4)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(0, 25))) for _ in range(r.randint(1, 9))]
        least = r.randint(1, len(lists))
        count = {x: sum(x in one for one in lists) for x in range(40)}
        assert list(jaccard_join.occurring(lists, least)) == [(x, n) for x, n in count.items() if n >= least]


def test_occurring_more_often_as_numbers_rise():
    r = random.Random(5)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(0, 25))) for _ in range(r.randint(1, 9))]
        least = r.randint(1, 3)
        need = sorted(r.randint(least, 9) for _ in range(40))
        count = {x: sum(x in one for one in lists) for x in range(40)}
        assert list(jaccard_join.occurring(lists, least, need.__getitem__)) == [(x, n) for x, n in count.items() if n >= need[x]]


def test_sets_tell_runs_apart():
    r = random.Random(6)
    texts = [" ".join(r.choices("abAé", k=r.randint(0, 9))) for _ in range(400)] + [None, " \t\n"]
    plain = lambda w: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    runs = [plain((t or "").replace("A", "a").split()) for t in texts]
    made = [set(x.tolist()) for x in jaccard_join.sets_of(texts, 4)]
    assert all(len(a) == len(b) for a, b in zip(runs, made)) and len(set().union(*runs)) == len(set().union(*made))
    assert all(len(a & b) == len(c & d) for a, c in zip(runs, made) for b, d in zip(runs[::7], made[::7]))


def test_sets_that_share_too_little_leave_the_search(monkeypatch):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    # Copies of one set with up to half of it exchanged: few link, all are in one block and most of their lists are long.
    sets = [np.unique(np.concatenate([base[r.random(400) >= x], r.integers(0, 2**63, int(400 * x), dtype=np.uint64)])) for x in np.linspace(0, 0.5, 200)]

    def groups(edges):
        root = list(range(200))
        for i, j in edges:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
        return root

    given, plain = [], jaccard_join.occurring
    monkeypatch.setattr(jaccard_join, "occurring", lambda lists, *rest: given.append(sum(map(len, lists))) or plain(lists, *rest))
    want = [(i, j) for i in range(200) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))]
    for ask in [np.ones(200, bool), r.random(200) < 0.5]:
        given.clear()
        got = [(max(p), min(p)) for p in jaccard_join.links(sets, ask, 85)]
        assert set(got) <= set(want) and groups(got) == groups([p for p in want if ask[p[0]] or ask[p[1]]])
        assert sum(given) < sum(map(len, sets)) // 2


@pytest.mark.parametrize("members", [2000, 7])
def test_jaccard_groups(spark, odd, members, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)  # 7: blocks in parts
    rows = near_copies(1, 25, [9, 40, 120]) + [(None, "only one of all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in jaccard_join.similarity_groups(docs).collect())
    assert got == plain_components(rows)
    if members > 7:
        found = jaccard_join.similarity_groups(odd).collect()
        assert sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in found) == plain_components(ODD)
        assert jaccard_join.similarity_groups(odd.where("false")).count() == 0


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n, part = j - i + q, w[i : j + q]
            if j > i and n >= max(6, 4 * q) and not any(part[d:] == part[: n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_as_plain():
    r = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 6)):
            k, w = r.choice([1, 2, 3, 5, 50]), []
            for _ in range(r.randint(0, 5)):
                unit = [r.randrange(k) for _ in range(r.randint(1, 40))]
                w += unit[: r.randint(0, 12)] if r.random() < 0.5 else (unit * 7)[: r.randint(1, 7 * len(unit))]
            texts.append(w)
        assert periodic_runs.runs([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]
    long = list(range(1500)) * 5
    assert periodic_runs.runs([np.array([7, *long, 8], np.int64)]) == [[(1, 7500, 1500)]]


def test_runs_query(spark, odd):
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    checked = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        found = plain_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None,) * 3
        digests = ["".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for i, x in enumerate(w) if i not in gone)]
        assert got[r.doc_id] == (r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))
        checked += len(found)
    assert checked > 20 and len(got) == 200
    rows = {(r.doc_id, r.collapsed): r.runs for r in periodic_runs.periodic_runs(odd).collect()}
    assert [tuple(x) for x in rows[7, "a"]] == [(0, 200, 1)] and rows[9, "x y z"][0].period == 3 and rows[1, ""] == [] and len(rows) == len(ODD) - 1
    assert periodic_runs.periodic_runs(odd.where("false")).count() == 0


def plain_codes(vectors, entries=16, rounds=6):
    v = np.floor(np.array(vectors, np.float64) * 4096).astype(np.int64).reshape(len(vectors), 8, -1)
    book = v[:entries].transpose(1, 0, 2).copy()
    for t in range(rounds + 1):
        far = ((v[:, :, None] - book[None]) ** 2).sum(-1)
        code = far.argmin(-1)
        if t < rounds:
            for p in range(8):
                for e in range(book.shape[1]):
                    if (code[:, p] == e).any():
                        book[p, e] = v[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    return ["".join(f"{c:02x}" for c in row) for row in code], far.min(-1).sum(1).tolist(), book


def test_bounds_settle_as_plain_rounds():
    r = np.random.default_rng(5)
    centres = r.integers(-900, 900, (12, 8, 4))
    v = centres[r.integers(0, 12, 3000)] + r.integers(-60, 60, (3000, 8, 4))
    history, state, scans = v[:16].transpose(1, 0, 2)[None].copy(), None, []
    for _ in range(7):
        state, scanned = vector_code.settle(v, state, history)
        far = ((v[:, :, None] - history[-1][None]) ** 2).sum(-1)
        assert (state["code"] == far.argmin(-1)).all()
        scans.append(scanned)
        book = history[-1].copy()
        for p in range(8):
            for e in range(16):
                if (state["code"][:, p] == e).any():
                    book[p, e] = v[state["code"][:, p] == e, p].sum(0) // (state["code"][:, p] == e).sum()
        history = np.concatenate([history, book[None]])
    assert scans[0] == v.shape[0] * 8 and scans[-1] < 0.5 * scans[0]
    net, others = vector_code.moved(history)
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(-1))
    assert (net[0] <= steps.sum(0) + 1e-9).all() and (net[-1] == 0).all() and (others >= 0).all()


def test_vector_codes_odd(spark):
    r = np.random.default_rng(3)
    good = [r.normal(0, 0.2, 16).astype(np.float32).tolist() for _ in range(60)] + [[0.0] * 16] * 3
    rows = [(i, x, i % 3 if i % 7 else None, "extra", b"") for i, x in enumerate(good)]
    bad = [None, [], [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0] * 15, [1.0] * 24, [3e38] * 16]
    kind = "vec_id long, embedding array<float>, label int, key string, code binary"
    df = spark.createDataFrame(rows + [(100 + i, x, 1, "", b"") for i, x in enumerate(bad)], kind).repartition(3)
    coded, books = vector_code.compressed(df)
    code, error, book = plain_codes(good)
    assert sorted((x.vec_id, bytes(x.code).hex(), x.error) for x in coded.collect()) == [(i, c, e) for i, (c, e) in enumerate(zip(code, error))]
    assert (books == book).all()
    few, small = vector_code.compressed(spark.createDataFrame(rows[:3] + [(None, good[0], None, "", b"")], kind))
    assert small.shape == (8, 4, 2) and sorted(x.error for x in few.collect()) == [0] * 4
    assert vector_code.compressed(df.where("false"))[0].count() == 0
