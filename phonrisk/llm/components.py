"""Connected components by alternating large and small stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.store import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: those above it, or those up to it."""
    if large:
        links = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = links.join(least, "u").select("v", "m", "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in ``edges`` (u, v), the component named by its least node.

    Each round halves the depth of the trees at least, so rounds grow with the logarithm of a
    component's size. A hub's edges are summed before the shuffle and split by skew joins. It ends
    when every node hangs on one root and no root hangs on another.
    """
    state = edges
    while True:
        state = stored(_star(_star(state, True), False), "stars")
        ends = state.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
            state.select("v", F.lit(0), F.lit(1)))
        seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if seen.filter("hangs + holds > 1").isEmpty():
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
