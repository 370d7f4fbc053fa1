"""Queries on streams of chunks. Each turn of a conversation is cut in two, within what its end holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT
from ..operators.detect import detect
from ..streaming.carried import bounded_stream, restored_stream
from ..streaming.registry import number_stream, run_available
from .placed import EMAIL, QUERIES, SQL
from .queries import query, read

__all__ = ["QUERIES", "SQL"]


def turns(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path + "*")  # a glob, as the table may be one file
    return rows.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def halves(rows: DataFrame, tail: str) -> DataFrame:
    """stream, seq, text and final of both halves of each turn with a tail, cut at some place of the tail."""
    whole = rows.withColumn("made", F.concat("text", F.expr(tail))).withColumn("cut", (F.length("text") + 1 + F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.length("made") - F.length("text"))).cast("int"))
    cut = F.array(F.struct(F.lit(0).alias("seq"), F.substring("made", F.lit(1), F.col("cut")).alias("text"), F.lit(False).alias("final")), F.struct(F.lit(1).alias("seq"), F.substring("made", F.col("cut") + 1, F.length("made")).alias("text"), F.lit(True).alias("final")))
    return whole.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), F.explode(cut).alias("c")).select("stream", "c.*")


def joined(given: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return given.groupBy("stream").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


@query("st_restore", "SELECT concat(conv_id, '/', turn) AS stream, concat(coalesce(text, ''), ' to N', conv_id, ' and M, not [[Person-1]]x') AS text FROM conversations")
def _restored(spark, d):
    maps = read(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), F.explode(F.array(*[F.struct(F.lit(t).alias("token"), v.alias("value")) for t, v in (("[[Person-1]]", F.concat(F.lit("N"), F.col("conv_id").cast("string"))), ("[[Person-12]]", F.lit("M")))])).alias("e")).select("stream", "e.*")
    return joined(run_available(spark, restored_stream(halves(turns(spark, d), "' to [[Person-1]] and [[Person-12]], not [[Person-1]]x'"), maps, "stream", "seq")))


_key = "chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(cast(conv_id as string)) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10)"


@query("st_boundary", f"SELECT concat(conv_id, '/', turn) AS stream, trim({_key}, chr(10)) AS value FROM conversations")
def _bounded(spark, d):
    """Key blocks that a cut goes through are found in what is given out."""
    given = run_available(spark, bounded_stream(halves(turns(spark, d), _key), "stream", "seq"))
    pieces = given.select(F.concat_ws(" ", "stream", F.col("seq").cast("string")).alias("piece"), "text")
    return detect(pieces, [r for r in DEFAULT if r.id == "private-key"], "piece").select(F.substring_index("piece", " ", 1).alias("stream"), "value")


@query("st_numbering", "SELECT conv_id, turn, CAST(length(coalesce(text, '')) + 1 AS BIGINT) AS start, 'EMAIL' AS type, concat('n', turn % 2, '@num.example.org') AS value, CAST(turn % 2 + 1 AS BIGINT) AS number FROM conversations")
def _numbered(spark, d):
    """The addresses behind the turns, two for each conversation in turn, keep their numbers over all batches."""
    made = turns(spark, d).select(F.struct("conv_id", "turn").alias("id"), F.concat("text", F.lit(" n"), (F.col("turn") % 2).cast("string"), F.lit("@num.example.org")).alias("text"))
    found = detect(made, EMAIL, "id").where(F.endswith("value", F.lit("@num.example.org"))).select("id.*", "start", "type", "value")
    return run_available(spark, number_stream(found, "conv_id", "turn"))
