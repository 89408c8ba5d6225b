"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join of an edge table with the smallest
neighbour of each node, which is broadcast while it is small; beyond, nodes of
very many edges get theirs by broadcast, so no node's neighbours meet in one
task.  Nothing but two numbers a round comes to the driver.  Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import FEW, durable, meet


def _told(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Edges with their node's smallest neighbour."""
    return rows.join(F.broadcast(least), "u") if few else meet(rows, durable(least, "least"), "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _told(both, least, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _told(down, least, few).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``u, v`` (long); root is the smallest node.

    Roots have no row of their own.  Self-loops and repeated edges are ignored;
    an empty table gives an empty result.
    """
    now = durable(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        few = 2 * mark[0] <= FEW  # as many nodes at most
        stars = _large_star(now, few)
        now = durable(_small_star(stars if few else durable(stars, "stars"), few), "edges")
