"""What executors and their Python workers hold: batches bounded by bytes, and nothing of a task that has ended."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievespark.llm import base, bpe

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)


@pytest.mark.parametrize("name", ["language_id", "simhash_dedup", "byte_bpe"])
def test_stages_bound_the_bytes_of_a_batch(spark, unset, name):
    none = corpus_pipeline.materialize(spark.createDataFrame([], "doc_id long, text string, lang string"))
    dict(corpus_pipeline.STAGES)[name](spark, none, "")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 6000 and max(r.size for r in found) < 1.1 * base.BATCH


def test_a_limit_that_is_set_stays(spark, unset):
    spark.conf.set(LIMIT, "1m")
    base.bound_batches(spark)
    assert spark.conf.get(LIMIT) == "1m"


def test_workers_keep_no_codec(spark):
    docs = spark.range(0, 64, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    assert bpe.encode_decode(docs, *bpe.vocabulary()).where("decoded = encode('some text 7', 'utf-8')").count() == 1

    def held(batches):
        for _ in batches:
            yield pa.record_batch({"n": pa.array([bpe.codec.cache_info().currsize], pa.int64())})

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
