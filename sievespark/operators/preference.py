"""Which type a merged span gets, and which of two detectors' findings stay where they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import overlapping
from .spans import ordered

# Types that take part in the preference.
NAMES = ["PERSON", "PROPER_NAME", "LOCATION", "ORGANIZATION", "EDUCATION"]
WHOLE = ["EMAIL", "PHONE", "ID", "VIN", "PASSPORT_NUMBER"]
TYPED = ["PERSON", "ORGANIZATION", "EDUCATION", "LOCATION"]
#: Longest typed finding that replaces what lies within it.
COMPACT = 160


def broad(kind: Column) -> Column:
    """A document's type that says little: an identifier or passport of any kind."""
    return kind.isin("ID", "PASSPORT") | (kind.contains("PASSPORT") & ~kind.isin("PASSPORT_MRZ", "PASSPORT_NUMBER"))


def takes_over(current: Column, candidate: Column, identities: list[str], transformed: list[str]) -> Column:
    """Whether a span of type current becomes one of candidate, which begins later or is shorter. The first case that holds decides.

    A whole JSON value stays; an encoded run only yields to that; a phone number takes all but a machine-readable zone, and an encoded run
    takes the rest. Then types with a transformation of their own, the zone, evidence over the guess of an attribute, and a particular
    identity over a broad one. It isn't symmetric, so the order of a span's findings counts."""
    attribute = (current == "PERSONAL_ATTRIBUTE") & candidate.isin(NAMES) | (candidate == "PERSONAL_ATTRIBUTE") & current.isin(NAMES)
    cases = [
        (current == "JSON_VALUE", False), (candidate == "JSON_VALUE", True), (current == "ENCODED_SENSITIVE", False), ((candidate == "PHONE") & (current != "PASSPORT_MRZ"), True),
        (candidate == "ENCODED_SENSITIVE", True), (current.isin(transformed), False), (candidate.isin(transformed) | (candidate == "PASSPORT_MRZ"), True), (attribute, candidate == "PERSONAL_ATTRIBUTE"),
    ]
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(broad(current) & candidate.isin(identities) & ~broad(candidate))


def typed_union(findings: DataFrame, key: str = "doc_id", identities: list[str] | None = None, transformed: list[str] | None = None) -> DataFrame:
    """key, start, end, category, type and n_findings of the merged spans (strictly overlapping ones): the type is folded over the
    span's findings in order of start, longest first, then rule. identities: particular types; transformed: those with a transformation of their own."""
    w = ordered(key)
    islands = findings.withColumn("top", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    islands = islands.withColumn("island", F.sum(F.when(F.col("start") < F.col("top"), 0).otherwise(1)).over(w))
    grouped = islands.groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.when(F.bool_or(F.col("category") == "credential"), "credential").otherwise("personal").alias("category"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "rule", "type"))), lambda x: x["type"]).alias("types"), F.count(F.lit(1)).alias("n_findings"))
    fold = F.aggregate(F.slice("types", F.lit(2), F.size("types")), F.get("types", F.lit(0)), lambda a, x: F.when(takes_over(a, x, identities or [], transformed or []), x).otherwise(a))
    return grouped.select(key, "start", "end", "category", fold.alias("type"), "n_findings")


def beside_prose(documents: DataFrame, prose: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (key, start, end, type, rule, value) of a documents' detector and of a prose detector in one table.

    A contact or identifier stays whatever it overlaps, and so does what overlaps nothing. A typed entity on one line, COMPACT characters
    at most, that holds all the prose it overlaps takes its place; any other finding of documents that overlaps prose goes. Prose that isn't replaced stays."""
    names = [key, "start", "end", "type", "rule", "value"]
    mine = documents.select(*names)
    met = overlapping(mine, prose.select(key, "start", "end"), key)
    held = (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end"))
    compact = F.col("type").isin(TYPED) & (F.col("end") - F.col("start") <= COMPACT) & ~F.col("value").rlike(r"[\t\r\n]")
    state = met.groupBy(*names).agg(F.bool_and(held).alias("holds")).withColumn("outcome", F.when(F.col("type").isin(WHOLE), "stays").when(compact & F.col("holds"), "covers").otherwise("goes"))
    judged = mine.distinct().join(state.select(*names, "outcome"), names, "left")
    covered = met.join(state.where("outcome = 'covers'").select(*names), names).select(key, F.col("r_start").alias("start"), F.col("r_end").alias("end")).distinct()
    return judged.where("outcome IS NULL OR outcome <> 'goes'").select(*names).unionByName(prose.select(*names).join(covered, [key, "start", "end"], "left_anti"))
