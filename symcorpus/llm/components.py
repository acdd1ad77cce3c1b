"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heaviest, looked_up, saved


def _to_least(edges: DataFrame, below: bool) -> DataFrame:
    """Links every neighbour of u (those above u, or those up to u) to the least of u and its neighbours."""
    if below:  # small star: neighbours up to u, and u itself
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = looked_up(near, least.drop("n"), ["u"], heaviest(least, ["u"])).select("u", "v", "found.m")
    if below:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the least node reachable.

    Each round is written to the shared folder, so that the plan stays short and a lost
    executor costs one round. Rounds grow with the logarithm of the longest chain. An empty
    edge table gives an empty result; repeated edges and loops are dropped.
    """
    now = saved(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v"), "edges")
    mark = None
    while True:
        now = saved(_to_least(_to_least(now, False), True), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
