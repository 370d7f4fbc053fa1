"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, salted_join


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for each node of edges (a, b).

    Each round turns a node's neighbours to the smallest of them (large-star, then small-star), so paths halve;
    edges stay as many as they were or fewer. Hubs are summed up before the shuffle and dealt over tasks, never gathered.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        size = pairs.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = materialize(salted_join(both.where("v > u"), least, ["u"], "v", size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted_join(large, down, ["u"], "v", size).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small)
        if same(pairs, after):
            break
        pairs = after
    else:
        raise RuntimeError("components did not settle")
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def same(one: DataFrame, two: DataFrame) -> bool:
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")]
    return one.agg(*mark).first() == two.agg(*mark).first()
