"""Repeated passages of lines, planted between different lines, against a plain version."""

import random

import corpus_pipeline


def plain(texts):
    first, out = {}, {}
    for d in sorted(texts):
        ls = texts[d].split("\n")
        gone = set()
        for i in range(len(ls) - 1):
            if first.setdefault((ls[i], ls[i + 1]), (d, i)) != (d, i):
                gone |= {i, i + 1}
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_planted_passages_go(spark):
    r, planted = random.Random(7), {}
    passages = [[f"passage {n} line {i}" for i in range(n)] for n in (2, 3, 5, 10)]
    texts = {0: "\n".join(x for p in passages for x in [*p, f"own {len(p)}"])}
    for d in range(1, 60):
        own = [f"text {d} line {i}" for i in range(r.randint(1, 6))]
        at = r.randint(0, len(own))
        texts[d] = "\n".join([*own[:at], *r.choice(passages), *own[at:]])
        planted[d] = "\n".join(own)
    texts |= {60: "x\ny\nz\nx\ny\nz", 61: "a\na\na", 62: "", 63: "one", 64: "one"}
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()] + [(65, None, None)], "doc_id long, text string, n_chars long").repartition(3)
    got = {x.doc_id: x for x in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert {d: x.text for d, x in got.items()} == plain(texts) | {65: None}
    assert {d: got[d].text for d in planted} == planted and got[0].text == texts[0]
    assert all(x.n_chars == len(x.text) for d, x in got.items() if d != 65)
    lines = lambda ts: {y for t in ts for y in (t or "").split("\n")}
    assert lines(x.text for x in got.values()) >= lines(texts.values())
