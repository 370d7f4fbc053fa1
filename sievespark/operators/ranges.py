"""Interval joins by document and range of places, and what is built on them: findings snapped to escapes, cut at separators and
mapped to the strings of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import placed_hits, running

#: Characters of a range. Intervals meet in the ranges that they touch, so the rows of one long text are spread too.
RANGE = 512
#: An escape of a JSON string, and what cuts a name: anything but blanks and the marks that stand within one.
ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|[\"\\/bfnrt])"
CUT = r"(?<![^\p{L}\p{M}\p{N}.-])[^\p{L}\p{M}\p{N}.\n\r-]*(?:\t|[^\p{L}\p{M}\p{N}\s.'-])[^\p{L}\p{M}\p{N}.\n\r-]*(?![^\p{L}\p{M}\p{N}.-])"
NAME_KEY = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


def _range(place: Column) -> Column:
    return F.floor(place / RANGE)


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """left's columns and right's, with r_ before their names, of each two intervals of a document that overlap, once.

    Both are dealt to the ranges that they touch, and a pair counts in the first range that it shares. Empty intervals overlap nothing.
    Neither side is broadcast, as both grow with the documents."""
    touched = lambda s, e: F.explode(F.sequence(_range(F.col(s)), _range(F.col(e) - 1))).alias("range")
    l_ = left.where("end > start").select("*", touched("start", "end"))
    r = right.where("end > start").select(key, *[F.col(c).alias("r_" + c) for c in right.columns if c != key]).select("*", touched("r_start", "r_end"))
    met = l_.join(r.hint("merge"), [key, "range"]).where((F.col("r_start") < F.col("end")) & (F.col("start") < F.col("r_end")))
    return met.where(F.col("range") == F.greatest(_range(F.col("start")), _range(F.col("r_start")))).drop("range")


def escapes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start and end of each escape; two backslashes are one."""
    found = docs.where(F.contains("text", F.lit("\\"))).select(key, F.explode(placed_hits(F.col("text"), ESCAPE)).alias("h"))
    return found.select(key, "h.start", (F.col("h.start") + F.length("h.value")).alias("end"))


def snapped(findings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings of which none begins or ends within an escape: it takes the whole of it."""
    spans = findings.select(key, "start", "end").distinct()
    wide = overlapping(spans, escapes(docs, key), key).groupBy(key, "start", "end").agg(F.min("r_start").alias("low"), F.max("r_end").alias("high"))
    joined = findings.join(wide.hint("merge"), [key, "start", "end"], "left")
    return joined.withColumns({"start": F.least("start", "low"), "end": F.greatest("end", "high")}).select(*findings.columns)


def split_names(findings: DataFrame, types: list[str]) -> DataFrame:
    """findings (with value) of which those of these types are cut at tabs and at marks other than . ' and -, so that what stands between the
    cells of a table or the values of a record is left; parts without a letter go. A break of lines alone cuts nothing."""
    parts = F.split("value", CUT, -1)
    cuts = F.concat(F.transform(F.regexp_extract_all("value", F.lit(CUT), F.lit(0)), lambda c: F.length(c)), F.array(F.lit(0)))
    ends = running(F.zip_with(parts, cuts, lambda p, c: (F.length(p) + c).cast("long")))
    placed = F.zip_with(F.arrays_zip(parts.alias("p"), cuts.alias("c")), ends, lambda x, e: F.struct((e - x["c"] - F.length(x["p"])).alias("at"), x["p"].alias("value")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("value")))
    each = F.when(F.col("type").isin(*types) & F.col("value").rlike(CUT), F.filter(placed, lambda p: p["value"].rlike(r"\p{L}"))).otherwise(whole)
    rows = findings.withColumn("part", F.explode(each))
    start = F.col("start") + F.col("part.at")
    return rows.withColumns({"start": start, "end": start + F.length("part.value"), "value": F.col("part.value")}).select(*findings.columns)


def in_leaves(findings: DataFrame, leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings of JSON texts, each in the strings it touches: as it is where it lies within one, else the whole content of each, as a part of a
    string isn't described by what crosses its end. What lies outside strings goes, and so do personal findings in keys that are plain names,
    unless known values: such a key isn't renamed."""
    strings = leaves.where("error IS NULL").select(key, "start", "end", "is_key", "value")
    met = overlapping(findings, strings, key)
    named = F.col("r_is_key") & (F.col("category") == "personal") & (F.col("rule") != "known-personal") & F.col("r_value").rlike(NAME_KEY)
    crosses = (F.col("start") < F.col("r_start")) | (F.col("end") > F.col("r_end"))
    said = {"value": "r_value"} if "value" in findings.columns else {}
    inner = met.where(~named).withColumns({c: F.when(crosses, F.col(r)).otherwise(F.col(c)) for c, r in {"start": "r_start", "end": "r_end", **said}.items()})
    return inner.select(*findings.columns).distinct()


def beside_keys(findings: DataFrame, leaves: DataFrame, key: str = "doc_id") -> DataFrame:
    """findings but for personal ones that touch a key that is a plain name; a known value stays."""
    keys = leaves.where(F.col("is_key") & F.col("value").rlike(NAME_KEY)).select(key, "start", "end")
    bound = overlapping(findings.where("category = 'personal' AND rule <> 'known-personal'").select(key, "start", "end").distinct(), keys, key).select(key, "start", "end").distinct().withColumn("bound", F.lit(True))
    joined = findings.join(bound.hint("merge"), [key, "start", "end"], "left")
    free = F.col("bound").isNull() | (F.col("category") != "personal") | (F.col("rule") == "known-personal")
    return joined.where(free).select(*findings.columns)
