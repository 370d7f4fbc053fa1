"""Texts are rewritten until nothing is left to find in them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged
from .spans import rendered, span_union

#: Rounds behind the first one.
ROUNDS = 3


def redacted_until_clean(docs: DataFrame, find: Callable[[DataFrame], DataFrame], replacement: Callable[[Column], Column] | str = "[REDACTED]", rounds: int = ROUNDS, key: str = "doc_id") -> DataFrame:
    """key, text, rounds (that changed the text), redactions (spans replaced in all) and error of each row of docs.

    Each round looks only at the texts that the one before has changed, which get fewer; what is left of
    a text that has findings after all rounds is not given out: its text is null and its error ERR_RESIDUAL. A null text has none.
    replacement is a text, or a function of a span's type. Each round's texts are a written table, so a round's work is never done again."""
    swap = (lambda kind: F.lit(replacement)) if isinstance(replacement, str) else replacement
    done = []
    left = docs.select(key, "text", F.lit(0).cast("long").alias("rounds"), F.lit(0).cast("long").alias("redactions"))
    for k in range(rounds + 2):
        lists = span_union(find(left.select(key, "text")), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", swap(F.col("type")).alias("replacement")))).alias("spans"))
        seen = staged(left.join(lists, key, "left"))
        clean = F.col("spans").isNull()
        done.append(seen.where(clean).select(key, "text", "rounds", "redactions", F.lit(None).cast("string").alias("error")))
        if k == rounds + 1:
            done.append(seen.where(~clean).select(key, F.lit(None).cast("string").alias("text"), "rounds", "redactions", F.lit("ERR_RESIDUAL").alias("error")))
            break
        left = seen.where(~clean).select(key, rendered(F.col("text"), F.col("spans")).alias("text"), (F.col("rounds") + 1).alias("rounds"), (F.col("redactions") + F.size("spans")).alias("redactions"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
