"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Edges of a graph whose nodes' smallest neighbours are sent to all tasks; of more they are joined by a
#: shuffle.
FEW_EDGES = 300_000


def _large_star(edges: DataFrame, hint) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, hint) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other that hangs on none: then nothing can change any more."""
    hung = edges.groupBy("a").agg(F.count("*").alias("n"))
    return hung.where("n > 1").isEmpty() and edges.select(F.col("b").alias("a")).distinct().join(hung, "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), of any type that has an order. Returns (node, component): each node that has an edge
    with another, and the smallest node of its component. Every round is written to the shared folder; the
    number of rounds grows with the logarithm of the largest component."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _all_stars(edges):
        hint = F.broadcast if edges.count() <= FEW_EDGES else lambda df: df
        edges = stored(_small_star(_large_star(edges, hint), hint), "components")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
