"""A corpus pipeline in five stages, each written as Parquet and read again before the next.

All stages: an empty table gives no rows, and columns besides doc_id and text are kept as they are, whatever their names (the last stage returns its own). Null and
empty texts go in the first stage; where a later one gets them, it keeps them, near duplicates one of them. Repeated rows and ids stay and are each
treated alike, but near duplicates keep one of each. A very long text is held whole by its task. Stages that use Python workers set the session's
spark.sql.execution.arrow.maxBytesPerBatch to 4 MB, unless it is set already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm import bpe, decontaminate, language_id, line_dedup, near
from sievespark.llm.base import bound_batches, discard, fold, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; those without a letter or any known n-gram go."""
    bound_batches(spark)
    return language_id.known_language(docs, language_id.learn(docs, fold(F.col("doc_id"), 4) != 2))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more go from the texts, but for the first of each; all documents stay."""
    return line_dedup.without_passages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of the sets of five-word shingles, and what such links reach) stays."""
    bound_batches(spark)
    return near.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the text decoded from them."""
    bound_batches(spark)
    made = bpe.encode_decode(docs, *bpe.vocabulary())
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", uncontaminated),
    ("byte_bpe", encoded),
]

#: Language ID and the ids have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if written:
            discard(written)  # the next stage's input is complete
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
