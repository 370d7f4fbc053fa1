"""Interval algebra over findings. All of it is by document, so rows of a document meet in one shuffle by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import staged
from .ranks import row_numbers


def ordered(key: str = "doc_id"):
    return W.partitionBy(key).orderBy("start", F.desc("end"), "rule")


def span_union(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merge strictly overlapping spans; touching ones stay apart. Credential wins the category, and the first type stays."""
    w = ordered(key)
    islands = findings.withColumn("top", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    islands = islands.withColumn("island", F.sum(F.when(F.col("start") < F.col("top"), 0).otherwise(1)).over(w))
    first = F.min(F.struct("start", (-F.col("end")).alias("e"), "rule", "type")).getField("type")
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.when(F.bool_or(F.col("category") == "credential"), "credential").otherwise("personal").alias("category"), first.alias("type"), F.count(F.lit(1)).alias("n_findings")).drop("island")


def same_span(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One finding for each span and type: the most confident, then the first rule."""
    w = W.partitionBy(key, "start", "end", "type").orderBy(F.desc("confidence"), "rule")
    return findings.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def drop_nested(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop a finding that lies within an earlier one of its type."""
    w = W.partitionBy(key, "type").orderBy("start", F.desc("end"), "rule").rowsBetween(W.unboundedPreceding, -1)
    return findings.withColumn("top", F.max("end").over(w)).where("top IS NULL OR end > top").drop("top")


def contained_anti(findings: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings that no span of the same type contains."""
    s = spans.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("t"))
    return findings.join(s, (F.col(key) == F.col("k")) & (F.col("type") == F.col("t")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_anti")


def overlap_semi(findings: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    s = spans.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    return findings.join(s, (F.col(key) == F.col("k")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_semi")


def overlapping(findings: DataFrame, of: Column, by: Column, key: str = "doc_id") -> DataFrame:
    """overlap_semi of the findings `of` holds for with those `by` holds for, never both of one; findings are read once.

    A finding overlaps one that starts before its end and ends behind its start: the largest end of those that start before its end tells."""
    w = W.partitionBy(key).orderBy(F.when(by, F.col("start")).otherwise(F.col("end")), by).rowsBetween(W.unboundedPreceding, 0)
    return findings.where(F.col(key).isNotNull() & (of | by)).withColumn("top", F.max(F.when(by, F.col("end"))).over(w)).where(of & (F.col("top") > F.col("start"))).drop("top")


def beyond_baseline(findings: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings left when each of a baseline's n entries of a fingerprint takes one; only fingerprints that it has are numbered, each over many tasks."""
    joined = staged(findings.join(known, "fp", "left"))  # read more than once below, as sorting by ranges samples first
    ranked = row_numbers(joined.where("n IS NOT NULL"), ["fp"], [key, "start"]).where("rn > n").drop("rn")
    return joined.where("n IS NULL").unionByName(ranked).drop("n")


def numbered(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of a value among those of its type in a document, by first appearance."""
    seen = findings.groupBy(key, "type", "value").agg(F.min("start").alias("first_start"))
    return seen.withColumn("number", F.dense_rank().over(W.partitionBy(key, "type").orderBy("first_start")).cast("long"))


def rendered(text: Column, spans: Column) -> Column:
    """text with the `replacement` of each of the disjoint spans, sorted by start, in its place; as it is without spans."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    gap = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], gap(a["at"], x["start"]), x["replacement"]).alias("out"))
    done = F.aggregate(spans, none, step, lambda a: F.concat(a["out"], gap(a["at"], F.length(text).cast("long"))))
    return F.when(spans.isNull(), text).otherwise(done)


def render(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The text of each document with the `replacement` of each disjoint span in its place, and their number."""
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("spans"))
    joined = docs.select(key, "text").join(lists, key, "left")
    return joined.select(key, rendered(F.col("text"), F.col("spans")).alias("text"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("redactions"))
