"""Connected components of a link table, by alternating star steps
(Kiveris et al. 2014): every step is an aggregation and a join, so no component
is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one root at most and no root has a root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of links (a, b): the root is the least
    node reachable. Nodes that are roots themselves have no row."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(edges):
        edges = materialize(_small_star(_large_star(edges)).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
