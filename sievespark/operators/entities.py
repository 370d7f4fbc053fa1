"""Mentions of one person in a text under one name: the only fuller one that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"
#: Parts of a name that are compared; a longer one stands for itself.
PARTS = 4


def parts_of(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(PART), F.lit(0)), lambda p: F.lower(p))


def fits(part: Column, other: Column) -> Column:
    """Whether a part of a name is the other part, or its initial."""
    return (part == other) | ((F.length(part) == 1) & other.startswith(part))


def covered(short: Column, full: Column) -> Column:
    """Whether each part of one name fits a part of the other, each its own: the parts are given to places in order, all choices at once."""
    start = F.array(F.array().cast("array<int>"))
    places = F.sequence(F.lit(0), F.size(full) - 1)

    def step(choices: Column, part: Column) -> Column:
        free = lambda taken: F.filter(places, lambda i: ~F.array_contains(taken, i) & fits(part, F.get(full, i)))
        return F.flatten(F.transform(choices, lambda taken: F.transform(free(taken), lambda i: F.concat(taken, F.array(i)))))

    return F.size(F.aggregate(short, start, step)) > 0


def resolved(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value and entity of each different mention (key, value) of a text: the fullest name that covers it, if there is one alone; else itself.

    A name covers another if the other's parts, or what they are initials of, are among its own, and it says more. Of those that
    cover a mention, only such as nothing covers count. Ambiguous mentions and initials alone stay apart. Names meet in an equi-join on the text and
    a mention's longest part, which the fuller name has too. Null values and values without a letter are left out."""
    names = mentions.select(key, "value").distinct().withColumn("parts", parts_of(F.col("value"))).where(F.size("parts") > 0)
    words = F.filter("parts", lambda p: F.length(p) > 1)
    lead = F.array_max(F.transform(words, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    short = names.where(F.size("parts") <= PARTS).select(key, F.col("value").alias("short"), F.col("parts").alias("a"), lead.alias("word")).where("word IS NOT NULL")
    full = names.where(F.size("parts") <= PARTS).select(key, F.col("value").alias("full"), F.col("parts").alias("b"), F.explode(F.array_distinct("parts")).alias("word"))
    letters = lambda ps: F.length(F.array_join(ps, ""))
    more = (F.size("b") >= F.size("a")) & (letters(F.col("b")) > letters(F.col("a")))
    pairs = short.join(full, [key, "word"]).where(more & covered(F.col("a"), F.col("b"))).select(key, "short", "full").distinct()
    top = pairs.join(pairs.select(key, F.col("short").alias("full")).distinct(), [key, "full"], "left_anti")
    one = top.groupBy(key, "short").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full")).where("n = 1")
    joined = names.select(key, "value").join(one.select(key, F.col("short").alias("value"), "full"), [key, "value"], "left")
    return joined.select(key, "value", F.coalesce("full", "value").alias("entity"))
