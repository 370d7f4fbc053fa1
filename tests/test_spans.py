from sievespark.functions.rules import DEFAULT
from sievespark.operators.detect import detect
from sievespark.operators.placeholders import placeholders, restore
from sievespark.operators.spans import render, span_union

TEXTS = [
    (1, "x 😀 mail jane.roe@mail.example and +44 20 7946 0958, jane.roe@mail.example"),
    (2, 'token = "0123456789abcdef" at 10.1.2.3 not 300.1.2.3'),
    (3, ""),
    (4, None),
    (5, "card 4111111111111111 and 4111111111111112"),
]


def findings(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return docs, detect(docs, DEFAULT)


def test_offsets_are_code_points(spark):
    docs, found = findings(spark)
    text = dict(TEXTS)
    rows = found.collect()
    assert {r.rule for r in rows} >= {"email", "international-phone", "context", "ipv4", "luhn"}
    assert all(text[r.doc_id][r.start : r.end] == r.value for r in rows)
    assert [r.value for r in rows if r.rule == "luhn"] == ["4111111111111111"]
    assert [r.value for r in rows if r.rule == "ipv4"] == ["10.1.2.3"]


def test_union_is_disjoint_and_touching_spans_stay_apart(spark):
    f = spark.createDataFrame([(1, 0, 5, "personal", "A", "a"), (1, 3, 8, "credential", "B", "b"), (1, 8, 9, "personal", "C", "c")], "doc_id long, start long, end long, category string, type string, rule string")
    assert sorted((r.start, r.end, r.category, r.type) for r in span_union(f).collect()) == [(0, 8, "credential", "A"), (8, 9, "personal", "C")]


def test_placeholders_come_back(spark):
    docs, found = findings(spark)
    done = placeholders(docs, found)
    rewritten = {r.doc_id: r.text for r in done.collect()}
    assert "jane.roe" not in rewritten[1] and "[[Email-1]]" in rewritten[1]
    assert {r.doc_id: r.text for r in restore(done).collect()} == dict(TEXTS)


def test_redaction_leaves_nothing(spark):
    from pyspark.sql import functions as F

    docs, found = findings(spark)
    out = render(docs, span_union(found).withColumn("replacement", F.lit("[REDACTED]")))
    assert detect(out.select("doc_id", "text"), DEFAULT).count() == 0
