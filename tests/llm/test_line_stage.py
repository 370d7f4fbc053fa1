"""The pipeline's line stage takes repeated chunks by op7's operator, and what their cuts miss by an exact check."""

from sievespark.llm import line_dedup


def test_chunks_come_from_the_operator(spark, monkeypatch):
    used, removals = [], line_dedup.removals
    monkeypatch.setattr(line_dedup, "removals", lambda docs: used.append(1) or removals(docs))
    passage = "\n".join(f"line {i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a\n" + passage + "\nb"), (2, "c\n" + passage + "\nd"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_passages(docs).collect()}
    assert used and got == {1: "a\n" + passage + "\nb", 2: "c\nd", 3: None}
