"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import HOT_ROWS, materialise, remove, spread


def _meet(left: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """left with the least neighbour m of u; a hub's edges are spread over several tasks."""
    if edges <= HOT_ROWS:  # no node can be a large hub
        return left.join(low.drop("n"), "u")
    left, right = spread(left, low, ["u"], "n", F.col("v"))
    return left.join(right, ["u", "__salt"])


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _meet(both.where("v > u"), low, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = _meet(down, low, count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node of its component. edges: columns u, v."""
    now = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark, count = None, now.count()
    while True:
        # the large step makes no more edges than it is given
        after = materialise(_small_star(_large_star(now, count), count), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(edges.sparkSession, now)
        now = after
        if tuple(found) == mark:
            break
        mark, count = tuple(found), found[0]
    # every edge now leads to the smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
