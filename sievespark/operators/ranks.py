"""Row numbers within groups, without a task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import staged


def row_numbers(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """df and in `name` each row's number, from 1, among the rows that agree in `by` (all of them, if there is none), in the order given.

    Rows are sorted over all tasks by ranges of both, and written; a group then lies in one run of tasks, however large it is. The counts of each
    task and group give where its rows begin. Rows that tie in everything have some order. Null is a group of its own."""
    cols = df.columns
    keys = [F.col(c) for c in by]
    sort = [*keys, *order]
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    numbered = staged(spread.select(*cols, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_at")))
    counts = numbered.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a task and group
    offsets = counts.select("_task", *[F.col(c).alias(f"_{c}") for c in by], "_first", before.alias("_before"))
    same = F.col("_task") == F.col("_t")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = numbered.join(offsets.withColumnRenamed("_task", "_t"), same)
    return joined.select(*cols, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias(name))
