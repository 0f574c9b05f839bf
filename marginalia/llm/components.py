"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest: of each node's larger neighbours (large), or of its smaller neighbours and itself (small).

    The smallest neighbour is aggregated before the shuffle, written and joined back:
    a node with many neighbours is never gathered, and Spark can split its rows.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = saved(around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
    hung = around.join(least.hint("shuffle_merge"), "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def _pairs(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def partial_labels(links: DataFrame) -> DataFrame:
    """Saved (a, b): for each node of ``links(a, b)`` a smaller node of the same component, or itself: its smallest neighbour's smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("b")), "lows")
    lower = low.select(F.col("a").alias("b"), F.col("b").alias("lower"))
    return saved(low.join(lower.hint("shuffle_merge"), "b").select("a", F.least("b", "lower").alias("b")), "labels")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every child has one parent, and no parent is a child."""
    if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    parents = saved(edges.select(F.col("b").alias("a")).distinct(), "parents")
    return edges.join(parents.hint("shuffle_merge"), "a", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b): each node of ``links(a, b)`` except the smallest of its component, and that smallest node. Saved. Turns follow until every component is a star."""
    spark = links.sparkSession
    edges = saved(_pairs(links), "links")
    while not _is_forest_of_stars(edges):
        after = saved(_star(_star(edges, True), False), "stars")
        dropped(spark, edges)
        edges = after
    return edges
