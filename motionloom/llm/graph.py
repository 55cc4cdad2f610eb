"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The component of each node that has an edge and isn't the smallest of its own: (node, component).

    edges: (u, v) as long, in any direction, repeated or not; loops and nulls count for nothing.
    Each step works on edges alone. The smallest neighbours are written down before the edges join
    them, so that Spark can split the edges of a hot node over tasks (skew join).
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.cut(pairs.where("u <> v").distinct(), "edges")
    while True:
        # of each node: its smallest neighbour or itself, how many neighbours are smaller, and whether one is larger
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("lo"), F.sum((F.col("v") < F.col("u")).cast("int")).alias("down"), F.max((F.col("v") > F.col("u")).cast("int")).alias("up"))
        low = scratch.cut(low, "low")
        # done when all are stars: no node has two smaller neighbours, or a smaller and a larger one
        if low.where("down > 1 OR down + up > 1").isEmpty():
            scratch.drop(low)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = scratch.cut(both.join(low.select("u", "lo"), "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v")).distinct(), "large")
        low2 = scratch.cut(large.groupBy("u").agg(F.min("v").alias("lo")), "low2")
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("lo"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("lo").alias("v"))
        after = scratch.cut(small.where("u <> v").distinct(), "edges")
        scratch.drop(now, low, large, low2)
        now = after
