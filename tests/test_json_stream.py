"""JSON leaves and the stream registry on small inputs."""

from pyspark.sql import functions as F

from sievespark.sources.json_leaves import duplicate_keys, leaves
from sievespark.streaming.registry import redact_stream, run_available


def test_leaves(spark):
    texts = [(1, '{"a": {"b": ["x", {"c": "é\\n😀"}]}, "a": "y"}'), (2, "{"), (3, None), (4, '"top"'), (5, "[]"), (6, '{"k": "v"}')]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = leaves(docs).join(docs, "doc_id").collect()
    for r in rows:
        if r.raw is not None:
            assert r.text[r.start : r.end] == r.raw
    got = sorted((r.doc_id, ".".join(r.path), r.value) for r in rows if r.error is None and not r.is_key)
    assert got == [(1, "a", "y"), (1, "a.b.0", "x"), (1, "a.b.1.c", "é\n😀"), (4, "", "top"), (6, "k", "v")]
    assert [r.doc_id for r in rows if r.error] == [2]
    assert [tuple(r) for r in duplicate_keys(leaves(docs)).collect()] == [(1, "a", 2)]


def test_registry_keeps_state_between_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "s string, n long, text string"
    batches = [[("a", 1, "Quill waits"), ("b", 1, "Quill waits")], [("a", 2, "my name is Quill.")], [("a", 3, "quill left, Quillon stayed"), ("a", 4, None), ("b", 2, "Quill again")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = {(r.s, r.n): (r.text, r.n_redacted, r.late) for r in run_available(spark, redact_stream(stream, "s", "n")).orderBy(F.col("n")).collect()}
    assert out == {
        ("a", 1): ("Quill waits", 0, False), ("b", 1): ("Quill waits", 0, False), ("a", 2): ("my name is [REDACTED].", 1, True),
        ("a", 3): ("[REDACTED] left, Quillon stayed", 1, False), ("a", 4): ("", 0, False), ("b", 2): ("Quill again", 0, False),
    }
