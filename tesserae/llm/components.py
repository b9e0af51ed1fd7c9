"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b), a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m")), "star")
    large = both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a != b").distinct()
    large = written(large, "large")
    least = written(large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a"), "star")
    joined = large.join(least, F.col("a") == F.col("_a"))
    small = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return written(small.filter("a != b").distinct(), "small")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre alone or has one edge to one; edges go from larger to smaller ids."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_top")).union(edges.select("b", F.lit(0), F.lit(1)))
    by = ends.groupBy("node").agg(F.sum("_in").alias("_in"), F.max("_top").alias("_top"))
    return by.filter("_in + _top > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: (node, label), for the nodes of links (a, b) alone.

    Edges are kept in written tables between steps; the driver only learns whether they are stars yet.
    A null or a link of a node with itself links nothing. No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    edges = written(edges, "edges")
    while not _are_stars(edges):
        edges = _stars(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
