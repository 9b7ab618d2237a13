"""Steps that depend on order: pacing, stopping, breadth-first reach, best groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .durable import kept


def paced(rows: DataFrame, key: str, arrival: str, order: list[str], spacing: float) -> DataFrame:
    """Launch times with at least ``spacing`` between launches of a key, none before its arrival.

    launch(i) = max(arrival(i), launch(i-1) + spacing) has the closed form spacing*i + max(arrival(j) - spacing*j, j <= i). Both the
    number i and the maximum are taken in two levels, inside stretches of arrival and over stretches, so a key's rows don't meet in one task.
    """
    out = rows.withColumn("__at", F.floor(F.col(arrival) / (1000.0 * spacing)))
    out = out.withColumn("nth", F.row_number().over(W.partitionBy(key, "__at").orderBy(arrival, *order)))
    before = W.partitionBy(key).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    counts = out.groupBy(key, "__at").agg(F.count(F.lit(1)).alias("n")).select(key, "__at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"))
    out = kept(out.join(counts, [key, "__at"]).withColumn("nth", F.col("nth") + F.col("__n")).drop("__n"))
    lead = F.col(arrival) - spacing * F.col("nth")
    most = out.groupBy(key, "__at").agg(F.max(lead).alias("m")).select(key, "__at", F.max("m").over(before).alias("__m"))
    inside = F.max(lead).over(W.partitionBy(key, "__at").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("__lead", inside).join(most, [key, "__at"])
    return out.withColumn("launch", F.greatest("__lead", "__m") + spacing * F.col("nth")).drop("__at", "__lead", "__m")


def until_nothing_new(rows: DataFrame, run: str, page: str, item: str) -> DataFrame:
    """Rows of pages before the first page of a run that brings no item not seen on an earlier page."""
    seen = rows.groupBy(run, item).agg(F.min(page).alias("first_page"))
    new = seen.groupBy(run, F.col("first_page").alias(page)).agg(F.count(F.lit(1)).alias("new_items"))
    pages = rows.select(run, page).distinct().join(new, [run, page], "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)))
    stop = pages.where("new_items = 0").groupBy(run).agg(F.min(page).alias("stop"))
    kept = pages.join(stop, run, "left").where(F.col("stop").isNull() | (F.col(page) < F.col("stop"))).select(run, page, "new_items")
    return rows.join(kept, [run, page])


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """``node, depth`` reachable over ``src, dst`` edges: a frontier join and an anti-join per level.

    Each level is written, so plans stay short and no level computes those before it again.
    """
    visited = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = kept(found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    return visited.orderBy("depth", "node").limit(max_nodes) if max_nodes else visited


def best_cluster(links: DataFrame, page: str, prefix: str, position: str, least: int = 3, hint: str = fixed.CLUSTER_HINT) -> DataFrame:
    """Highest scoring group of links of each page: size, plus ten for a telling prefix; ties to the group seen first."""
    groups = links.groupBy(page, prefix).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))
    score = F.col("n") + F.when(F.col(prefix).rlike(f"(?i){hint}"), 10).otherwise(0)
    top = groups.withColumn("score", score).groupBy(page).agg(F.max_by(F.struct(prefix, "n", "score"), F.struct("score", -F.col("first_at"))).alias("g"))
    return top.select(page, "g.*").where(F.col("n") >= least)


def group_score(links: str, lengths: str):
    """Score of a group of repeated elements from a 0/1 array of links and an array of text lengths (first ten each)."""
    few_links, few = F.slice(links, 1, 10), F.slice(lengths, 1, 10)
    size = F.size(few)
    mean = F.aggregate(few, F.lit(0.0), lambda a, x: a + x) / size
    spread = F.sqrt(F.aggregate(few, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / size) / F.nullif(mean, F.lit(0.0))
    share = F.aggregate(few_links, F.lit(0.0), lambda a, x: a + x) / size
    return F.least(F.lit(1.0), share * 0.3 + F.when(spread < 0.5, 0.2).when(spread < 1.0, 0.1).otherwise(0.0) + F.when((mean > 20) & (mean < 500), 0.15).otherwise(0.0))
