"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least_neighbour(both), "u").select(
        F.col("v").alias("u"),
        F.col("m").alias("v"),
    ).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    least = _least_neighbour(edges)
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points to one least node that points nowhere."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    onward = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return several.union(onward).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    ``edges`` has two long columns, the ends of each edge.  Nulls and loops are
    ignored, repeated edges count once; an empty table has no nodes.  The stars
    of a frequent node meet through its least neighbour only, which is
    aggregated before the shuffle.
    """
    a, b = edges.columns
    plain = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(plain, "edges")
    while not _is_star_forest(now):
        now = written(_small_star(_large_star(now)), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
