"""The pipeline's line stage is op7's operator, with its exact check of passages, and the operator counts what goes."""

from test_passages import plain

import corpus_pipeline
from sievespark.llm import line_dedup as L


def test_the_stage_runs_the_operator(spark, monkeypatch):
    ran, whole = [], L.line_dedup
    monkeypatch.setattr(L, "line_dedup", lambda docs, passages=False: ran.append(passages) or whole(docs, passages))
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()} == {1: "a\nb\nc", 2: "x", 3: None}
    assert ran == [True]


def test_passages_are_counted(spark):
    common = "\n".join(f"line {i}" for i in range(30))
    texts = {1: "own 1\n" + common, 2: common + "\nown 2", 3: "a\nb", 4: "c\na\nb\na\nb", 5: "", 6: "a\na\na"}
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()] + [(7, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in L.line_dedup(docs, passages=True).collect()}
    kept = plain(texts)
    assert {d: r.text for d, r in got.items()} == kept | {7: None}
    for d, t in texts.items():
        stay = 0 if not kept[d] and t else len(kept[d].split("\n"))
        assert (got[d].line_dedup.n_lines, got[d].line_dedup.n_removed) == (len(t.split("\n")), len(t.split("\n")) - stay)
        assert got[d].n_chars == len(kept[d])
    assert (got[7].line_dedup.n_lines, got[7].line_dedup.n_removed) == (0, 0)
    # the chunks alone, as op7 has them, take no more than passages do
    chunks = {r.doc_id: r.line_dedup.n_removed for r in L.line_dedup(docs).collect()}
    assert all(chunks[d] <= got[d].line_dedup.n_removed for d in chunks) and chunks[2] > 0
