"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialise


def _are_stars(edges: DataFrame) -> bool:
    """Every node either points to one other or is pointed to."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is its smallest node.

    Each round links every node to the smallest node it sees, first its larger
    neighbours, then the rest; rounds grow with the logarithm of a component's
    diameter. Neighbours are never gathered: a round is a minimum per node,
    combined map-side, and a join with it. The links are written after each
    round until they are stars.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
