"""Made-up names in place of found ones: each value of a table gets its own, and none is a value that is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .spans import render

#: Syllables of made-up names; a name is a number in their base, so different numbers are different names.
HEADS, TAILS = "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), "n r s l m".split()
#: Numbers for each value that is to get one: proposals then rarely meet.
SPACE, ROUNDS = 8, 40


def name_of(number: Column, places: int) -> Column:
    """A word of so many syllables that stands for the number."""
    n = len(HEADS)
    heads = F.array(*map(F.lit, HEADS))
    syllables = [F.get(heads, (F.floor(number / n**i) % n).cast("int")) for i in range(places)]
    return F.initcap(F.concat(*syllables, F.get(F.array(*map(F.lit, TAILS)), (F.floor(number / n**places) % len(TAILS)).cast("int"))))


def assigned(values: DataFrame, existing: DataFrame, key: str = "") -> DataFrame:
    """value and fake for each different value of values (value): no fake twice, and none that is in existing (value) or values, whatever the case.

    In each round the values without one propose a number by a keyed hash; the least value of those that propose the same gets it,
    unless it is given or a known value, and the others propose anew. Rounds are written tables of what is left, which is about an eighth
    of the round before. The same values, known values and key give the same fakes."""
    left = staged(values.select("value").where("value IS NOT NULL").distinct())
    space = max(1024, SPACE * left.count())
    places = 1
    while len(HEADS) ** places * len(TAILS) < space:
        places += 1
    known = staged(existing.select("value").unionByName(left).where("value IS NOT NULL").select(F.lower("value").alias("word")).distinct())
    given: DataFrame | None = None
    for k in range(ROUNDS):
        proposed = left.withColumn("number", F.pmod(F.xxhash64("value", F.lit(key), F.lit(k)), F.lit(space))).withColumn("fake", name_of(F.col("number"), places))
        if given is not None:
            proposed = proposed.join(given.select("number"), "number", "left_anti")
        free = proposed.withColumn("word", F.lower("fake")).join(known, "word", "left_anti")
        won = free.groupBy("number", "fake").agg(F.min("value").alias("value")).select("value", "number", "fake")
        given = staged(won if given is None else given.unionByName(won))
        left = staged(left.join(given.select("value"), "value", "left_anti"))
        if left.isEmpty():
            return given.select("value", "fake")
    raise RuntimeError("some values found no name of their own")


def with_fakes(docs: DataFrame, found: DataFrame, key: str = "doc_id", secret: str = "") -> DataFrame:
    """key, text and redactions of each text with made-up names in place of its findings (key, start, end, value; disjoint): one value has the same name in all texts,
    and no name is one of the words of the texts."""
    words = docs.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))).alias("value")).distinct()
    named = assigned(found, words, secret)
    return render(docs, found.join(named, "value").select(key, "start", "end", F.col("fake").alias("replacement")), key)
