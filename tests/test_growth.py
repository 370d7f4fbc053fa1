"""What keeps the work of a query in proportion to its tables: texts read once, rows dealt over tasks, small batches."""

from pyspark.sql import functions as F

from sievespark.functions.rules import DEFAULT
from sievespark.operators import document_profile as D
from sievespark.operators import records as R
from sievespark.operators import spans as P
from sievespark.operators.detect import detect
from sievespark.plans import policies
from sievespark.plans.placed import QUERIES
from sievespark.sources.files import decode_content
from sievespark.sources.json_leaves import leaves

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotated_texts_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(policies, "detect", lambda t, *a: read.append(t.count()) or detect(t, DEFAULT[:1]))
    policies.QUERIES["agg_benchmark"](spark, SF)
    assert read == [policies.docs(spark, SF).count()]


def test_cues_are_found_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("Full name: Anna Smith. Anna Smith said").alias("text"))
    found = detect(docs, D.CUES[:1])
    assert plan(D.accumulated(found)).count("Range (") == plan(found).count("Range (")
    assert sorted(tuple(r) for r in D.accumulated(found).select("doc_id", "start", "confidence").collect()) == [(i, 11, 0.75) for i in range(3)]


def test_bytes_go_to_python_in_small_batches(spark):
    made = spark.range(3).select(decode_content(F.lit(b"a\xff")).alias("c"))
    assert "ArrowEvalPython" not in plan(made) and made.first().c.error == "ERR_ENCODING"


def test_rows_of_a_small_file_are_dealt(spark):
    texts = spark.range(1000).repartition(1).select(F.col("id").alias("doc_id"), F.lit('{"a":"b\\"c"}').alias("text"))
    found = leaves(texts)
    assert "hashpartitioning(doc_id" in plan(found) and found.where("NOT is_key").first().value == 'b"c'
    assert "hashpartitioning(c_custkey" in plan(policies.QUERIES["fake_iban"](spark, SF))


def test_records_are_cut_in_one_pass(spark):
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("first_name: Anna\nlast_name: Smith\n\nsurname,given\nSmith,Anna").alias("text"))
    parts = R.parts_of(docs)
    assert plan(parts).count("Range (") == 1 and "Exchange" not in plan(parts)
    assert sorted((r.rec.split()[0], r.role) for r in parts.where("doc_id = 1").collect()) == [("pair", "given"), ("pair", "surname"), ("row", "given"), ("row", "surname")]


def test_hints_are_those_of_the_pattern(spark):
    texts = spark.createDataFrame([(x,) for x in ("a FIRST b", "laſt", "FİRST gıven", "ИМЯ", "ОТЧЕСТВО", "oᲂᲂтчеᲃᲄво", "f name", "Fname", "surnam", "", "ſİ")], "t string")
    assert texts.where(R.named(F.col("t")) != F.col("t").rlike(R.HINT)).count() == 0 and texts.where(R.named(F.col("t"))).count() == 7


def test_overlaps_are_found_in_one_pass(spark):
    rows = [(d, "pc"[(i * 7 + d) % 2], (i * 5 + d) % 23, (i * 5 + d) % 23 + i * d % 6) for d in range(1, 9) for i in range(20)] + [(None, "p", 0, 9), (None, "c", 0, 9)]
    found = spark.createDataFrame(rows, "doc_id long, category string, start long, end long")
    made = P.overlapping(found, F.col("category") == "p", F.col("category") == "c")
    want = P.overlap_semi(found.where("category = 'p'"), found.where("category = 'c'"))
    assert made.exceptAll(want).count() == want.exceptAll(made).count() == 0 < want.count()
    assert plan(QUERIES["join_contain_fake"](spark, SF)).count("Scan parquet") <= 1
