"""Connected components by alternating large-star and small-star steps, each settled in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the smallest node of its component.

    Nodes can be of any type that has an order. Loops and repeated edges do no harm; null nodes are left
    out. Sums are taken before the shuffle, and the only joins are on a node with one row on the other
    side, so a hub's rows can be split.
    """
    now = edges.select("a", "b").where("a != b")
    while True:
        now = settle(_small_star(_large_star(now).distinct()).distinct(), "edges")
        # Done when every edge leads to a node that leads nowhere, and no node leads to two of them.
        passed_on = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if passed_on.isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
