"""run() against a plain version of all stages, and each stage with odd inputs."""

import hashlib
import random
import re

import pytest
from test_near import plain_survivors
from test_operators import plain_language
from test_passages import plain as plain_lines

import corpus_pipeline
from sievespark.llm import bpe

LICENSE = "\n".join(f"licence line number {i} of the common text" for i in range(6))
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def rows():
    r, out = random.Random(11), []
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    for i in range(70):
        lang = ("aa", "bb")[i % 2]
        words = ["".join(r.choices(letters[lang], k=r.randint(3, 8))) for _ in range(r.randint(20, 60))]
        t = "\n".join(" ".join(words[j : j + 7]) for j in range(0, len(words), 7))
        if i % 5 == 0:
            t += "\n" + LICENSE
        if i % 9 == 0:
            t += "\n" + ITEM.upper()
        out.append((i, t, lang))
    for i in range(12):  # near copies: one word changed
        base = out[i * 3][1].split(" ")
        base[len(base) // 2] = "changedword"
        out.append((100 + i, " ".join(base), out[i * 3][2]))
    out += [(200 + i, out[1][1], "bb") for i in range(9)]  # exact copies
    return out + [(300, None, "aa"), (301, "", "aa"), (302, "12345 !?", None), (303, "Одно слово", None), (304, " \n ", "bb")]


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))


def plain(rows, items, encode):
    import zlib

    learned = {(t, k) for i, t, k in rows if t is not None and k and zlib.crc32(str(i).encode()) % 4 != 2}
    known = plain_language([t or "" for _, t, _ in rows], learned)
    docs = {i: t for (i, t, _), k in zip(rows, known) if t and any(x.isalpha() for x in t) and k}
    docs = plain_lines(docs)
    docs = {i: docs[i] for i in plain_survivors(docs)}
    bad = [plain_words(x) for x in items if plain_words(x)]
    holds = lambda t, w: any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))
    windows = [w[i : i + 10] for w in bad for i in range(max(1, len(w) - 9))]
    docs = {i: t for i, t in docs.items() if not any(holds(plain_words(t), w) for w in windows)}
    return {i: (len(encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}


@pytest.fixture
def made(spark, tmp_path):
    items = [ITEM, "two words", None, ""]
    spark.createDataFrame([(i, t, k, "s", None if t is None else len(t)) for i, t, k in rows()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_run_is_the_plain_version(spark, made):
    import tiktoken

    path, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    where, items = made
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, where).collect()}
    assert got == plain(rows(), items, enc.encode_ordinary) and 40 < len(got) < 80


def test_stages_with_odd_rows(spark, made):
    where, _ = made
    docs = spark.createDataFrame([(1, None, "x", "l"), (2, "", "y", "l"), (None, "one", "z", None), (None, "one", "z", None), (3, "one", "z", "l"), (4, "w " * 30_000, "u", "l"), (4, "w " * 30_000, "u", "l")], "doc_id long, text string, fp string, lang string")
    docs = corpus_pipeline.materialize(docs)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), where).count() == 0
        out = stage(spark, docs, where)
        ids = sorted(r.doc_id or 0 for r in out.collect())
        assert name == "byte_bpe" or out.columns == docs.columns
        # "one" stands in one different text, and other n-grams of its language stand twice, so none of its n-grams is known
        assert ids == {"language_id": [4, 4], "simhash_dedup": [1, 3, 4]}.get(name, [0, 0, 1, 2, 3, 4, 4]), name
