"""Connected components of a large edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; the root is the smallest node of the component.

    Each step is a minimum per node (partially aggregated before its shuffle) and an equi-join, so a node with very
    many neighbours never has them gathered. Rounds are written to the shared folder.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialise(e, "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node move to the node's smallest neighbour.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, e = e, materialise(moved.unionAll(down.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        forget(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
