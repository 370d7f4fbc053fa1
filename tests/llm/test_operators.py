"""Dealt operators: SQL on the smallest tables, plain versions on small made rows, and odd inputs."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sievespark.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, quality, registry, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one"), (5, LONG), (6, LONG + " end"), (7, "a " * 200), (8, "é日 ß"), (9, "x\ny\nz\nx\ny\nz\nx\ny\nz")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "k", 1, "extra") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = c.sql(registry.oracle_sql()[name])
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(k)] for k in df.columns) for r in want.fetchall()), key=repr)


def test_accuracy(spark):
    c = duckdb.connect()
    found = {r.doc_id: r for r in language_id.op4_language_id(spark, SF).collect()}
    lang = dict(c.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [i for i, r in found.items() if r.held_out]
    assert held and sum(found[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)
    larger = SF.replace("0.001", "0.01")  # the smallest tables hold out one label 0
    scored = {r.doc_id: r for r in quality.op1_quality(spark, larger).collect()}
    known = [(i, q) for i, q in c.sql(f"SELECT doc_id, quality FROM '{larger}/labels.parquet'").fetchall() if scored[i].held_out]
    for label in (0, 1):
        assert sum(scored[i].predicted == q for i, q in known if q == label) >= 0.85 * sum(q == label for _, q in known)
    assert all(0 <= r.score <= 1 for r in scored.values())


def test_prior_from_positives_alone():
    r = np.random.default_rng(0)
    pos, neg = r.normal(1, 0.3, (600, 4)).astype(np.float32), r.normal(-1, 0.3, (300, 4)).astype(np.float32)
    assert abs(quality.class_prior(pos[:300], np.vstack([pos[300:], neg])) - 0.5) < 0.15


def test_odd_substrings(odd, none):
    rows = {r.doc_id: r for r in substring_dedup.substring_dedup(odd).collect()}
    assert rows[5].n_removed == 30_000 and rows[6].n_removed == 30_000 and rows[6].kept == "end"
    assert rows[7].n_removed == 200 and rows[1].n_words == 0 and rows[4].n_removed == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_odd_exact(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.keep_id for r in empty} == {3} and all(r.group_size == 3 for r in empty)
    assert {r.keep_id for r in rows if r.doc_id in (4, None)} == {4}
    kept = [r.keep_id for r in rows if r.kept]
    assert len(kept) == len(set(kept)) == len({r.keep_id for r in rows}) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_large_group_keeps_one_row(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "a b" if i % 2 else "ab") for i in range(2000)] + [(1, "own")], "doc_id long, text string").repartition(4)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.group_size) for r in rows if r.kept) == [(1, 1), (7, 2000)] and len(rows) == 2001


def test_clashing_digests(spark):
    texts = ["".join(random.Random(i % 9).choices("abcdefgh", k=3000)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs, digest_bytes=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, i % 9, 4 if i % 9 < 3 else 3) for i in range(30)}


def plain_groups(fp: dict, radius: int = 4) -> dict:
    left, out = set(fp), {}
    while left:
        todo, seen = [min(left)], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in left if bin(fp[x] ^ fp[y]).count("1") <= radius]
        out |= dict.fromkeys(seen, min(seen))
        left -= seen
    return out


def test_simhash_links(spark, odd, none, monkeypatch):
    r = random.Random(3)
    fps = []
    for k in range(60):
        x = r.getrandbits(64) if k % 2 else 0xFFFF << 20 | r.getrandbits(16)  # half of them share blocks of bits
        for _ in range(r.randint(1, 8)):
            fps.append(x)
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in set(fps)], "fp long")
    for radius, whole, half, load in ((4, simhash.WHOLE, simhash.HALF, simhash.LOAD), (4, 2, 3, 0), (9, 3, 4, 1)):
        for name, value in (("WHOLE", whole), ("HALF", half), ("LOAD", load)):
            monkeypatch.setattr(simhash, name, value)
        want = plain_groups(dict(enumerate(fps)), radius)
        roots = {row.node: row.root for row in simhash.components(simhash.edges(df, radius).where("figures IS NULL")).collect()}
        got = defaultdict(set)
        for i, x in enumerate(fps):
            s = int(np.uint64(x).astype(np.int64))
            got[roots.get(s, s)].add(i)
        assert {frozenset(v) for v in got.values()} == {frozenset(i for i in want if want[i] == k) for k in set(want.values())}
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_groups(none).count() == 0


def plain_fingerprint(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    each = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))


def test_fingerprints(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    r = random.Random(8)
    texts = [" ".join(r.choice(["A", "b", "É", "ccc", "d\n"]) for _ in range(r.randrange(40))) for _ in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = sorted((d or -1, plain_fingerprint(t)) for d, t in [*ODD, *((100 + i, t) for i, t in enumerate(texts))])
    assert sorted((row.doc_id or -1, row.fp % 2**64) for row in simhash.fingerprints(docs).collect()) == want


def test_pivots_discard(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(int(np.uint64(r.getrandbits(64)).astype(np.int64)),) for _ in range(3000)], "fp long")
    pairs, checked = simhash.edges(df, 4).where("figures IS NOT NULL").selectExpr("sum(figures[0])", "sum(figures[1])").first()
    assert pairs > 1000 and checked < 0.001 * pairs


def test_bpe(spark, odd, none, monkeypatch):
    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(5)
    for k in range(150):
        text = "".join(r.choice("aab eéeß0\n!日") for _ in range(r.randint(0, 900)))
        text = text.replace(" ", "") if k % 2 else text
        assert np.frombuffer(own.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    monkeypatch.setattr(bpe, "LEAF", 1)  # trees down to single bytes
    tree = bpe.Codec(path, pattern)
    for n in (1, 2, 3, 50, 900, 20_000):
        text = "".join(r.choice("abcdefgh tionßé日") for _ in range(n)).replace(" ", "")
        assert [i for m in tree.split(text) for i in tree.encode_bytes(m.encode())] == enc.encode_ordinary(text)
    for row in bpe.encode_decode(odd, path, pattern).collect():
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() in [enc.encode_ordinary(t or "") for d, t in ODD if d == row.doc_id]
    assert bpe.encode_decode(none, path, pattern).count() == 0


def test_chat(spark):
    import public_tokenizers

    rows = [(1, 0, "user", "a\\<|im_end|> b"), (1, 1, "assistant", " é日\\|<|x"), (1, 2, "assistant", None), (2, None, None, "q"), (None, 1, "assistant", ""), (1, 1, "assistant", " é日\\|<|x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    said = rows[1][3] * 2
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said) and got[1].n_turns == 4
    assert set(got) == {1, 2, None} and got[2].loss_chars == 0
    ties = [(7, 1, None, "b"), (7, 1, "", "a"), (7, None, "assistant", "last"), (7, 0, "assistant", "x<|y " * 300_000)]
    made = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(ties, df.schema), public_tokenizers.path("byte_bpe_50k.json"))).first()
    order = [("assistant", ties[3][3]), ("", "a"), ("", "b"), ("assistant", "last")]
    assert made.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert made.loss_chars == 1_500_004 and made.loss_sha256 == hashlib.sha256((ties[3][3] + "last").encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(df.where("false"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_odd_lines_windows_languages(spark, odd, none):
    done = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(odd).collect()}
    assert len(done) == len(ODD) - 1 and done[1, None].line_dedup.n_lines == 0
    assert line_dedup.line_dedup(none).count() == 0
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "One"), (3, None), (None, "ß"), (2, "nowhere at all")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(odd, items).collect()}
    assert rows[5].n_hit == 11 and rows[4].n_items == 1 and rows[1].n_hit == 0 and rows[8].n_hit == 1
    assert decontaminate.decontaminate(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(odd, items.where("false")).collect()} == {0}
    filters = language_id.learn(odd, odd.doc_id > 0)
    assert {r.lang_pred for r in language_id.predict(odd, filters).where("doc_id < 4").collect()} == {"und"}
    assert language_id.known_language(odd, filters).columns == odd.columns
    assert language_id.predict(odd, language_id.learn(none, none.doc_id > 0)).where("lang_pred = 'und'").count() == len(ODD)
    assert quality.score(odd, None).where("score = 0.5").count() == len(ODD)


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0.8 * len(ids) < len(out) <= len(ids) and set(out) <= ids
    assert all(r.n_tokens * 4 == len(r.ids) for r in out.values())
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.materialize(stage(spark, seen, SF))
        assert seen.columns == docs.columns, name
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in seen.collect()} == {i: r.decoded_sha256 for i, r in out.items()}


def test_non_negative_risk_by_numeric_gradient():
    """Where the bracket is positive a step follows the gradient of the risk, where it is negative it goes back along the bracket's."""
    r = np.random.default_rng(1)
    pos, unl = (quality.with_one(r.normal(m, 1, (n, 3)).astype(np.float64)) for m, n in ((0.5, 40), (-0.5, 60)))
    s = lambda x, w: 1 / (1 + np.exp(-(x @ w)))
    seen = set()
    for prior in (0.2, 0.95):
        for w in (np.zeros(4), np.array([2.0, 2, 2, 0])):
            bracket = lambda w: s(unl, w).mean() - prior * s(pos, w).mean()
            risk = lambda w: prior * (1 - s(pos, w)).mean() + bracket(w)
            f = risk if bracket(w) >= 0 else lambda w: -bracket(w)
            wanted = np.array([(f(w + e) - f(w - e)) / 2e-5 for e in np.eye(4) * 1e-5])
            assert np.allclose(quality.nnpu_step(pos, unl, prior, w), wanted, atol=1e-5)
            seen.add(bracket(w) >= 0)
    assert seen == {True, False}


def test_prior_halves_share_no_text():
    """Texts that are positives and unlabelled at once don't move the prior."""
    r = np.random.default_rng(2)
    pos, neg = r.normal(1, 0.3, (400, 4)).astype(np.float32), r.normal(-1, 0.3, (300, 4)).astype(np.float32)
    assert abs(quality.class_prior(pos, np.vstack([pos[:300], neg])) - 0.5) < 0.15
    assert quality.class_prior(pos[:1], neg) == 0.5


def plain_language(texts, learned, lengths=(3, 4)):
    """Shares of known n-grams by sets, with no filter: what the Bloom filters estimate."""
    of = defaultdict(Counter)
    for t, lang in learned:
        data = b" " + b" ".join(t.lower().encode().split()) + b" "
        for n in lengths:
            of[lang].update(data[i : i + n] for i in range(len(data) - n + 1))
    total = {k: sum(v.values()) for k, v in of.items()}
    top = Counter()
    for k, v in of.items():
        for g, n in v.items():
            top[g] = max(top[g], n / total[k])
    known = {k: {g for g, n in v.items() if n / total[k] >= 0.2 * top[g] and (n > 1 or max(v.values()) == 1)} for k, v in of.items()}
    out = []
    for t in texts:
        data = b" " + b" ".join(t.lower().encode().split()) + b" "
        grams = [data[i : i + n] for n in lengths for i in range(len(data) - n + 1)]
        share = {k: sum(g in known[k] for g in grams) / max(1, len(grams)) for k in known}
        out.append(max(sorted(share), key=share.get) if max(share.values()) else None)
    return out


def test_languages_as_plain_sets(spark, monkeypatch):
    r = random.Random(6)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "klmnopq"}
    text = lambda k: " ".join("".join(r.choices(letters[k], k=r.randint(2, 7))) for _ in range(r.randint(3, 40)))
    rows = [(i, text(k), k) for i, k in enumerate(list(letters) * 40)] + [(900, "zzzz yyyy", "dd")] + [(901 + i, "rrrr", "ee") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    usable = docs.doc_id % 4 != 2
    want = plain_language([t for _, t, _ in rows], {(t, k) for i, t, k in rows if i % 4 != 2})
    for tile in (language_id.TILE, 5):
        monkeypatch.setattr(language_id, "TILE", tile)
        filters = language_id.learn(docs, usable)
        assert filters.languages == ["aa", "bb", "cc", "dd", "ee"]
        assert [filters.decide(t)[0] for _, t, _ in rows] == want
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        language_id.learn(docs, usable)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (7, 1), (8, 1), (9, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    w = quality.learn(odd, labels, quality.F.col("doc_id") != 9)
    assert len({r.score for r in quality.score(odd, w).where("doc_id = 4").collect()}) == 1 and quality.score(odd, w).count() == len(ODD)
    assert quality.learn(none, labels, quality.F.lit(True)) is None and quality.learn(odd, labels.where("false"), quality.F.lit(True)) is None
    assert quality.score(none, w).count() == 0
    long = "ab c" * 1000
    whole = quality.features(long)
    quality.TILE, kept = 100, quality.TILE
    try:
        assert (quality.features(long) == whole).all()
    finally:
        quality.TILE = kept
