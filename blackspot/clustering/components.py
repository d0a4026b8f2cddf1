"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.joins import split_join
from blackspot.runtime import cut


def least_of(edges: DataFrame) -> DataFrame:
    """Per node ``a``: its smallest neighbour ``m`` and the number of its edges."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = least_of(both).withColumn("m", F.least("a", "m"))
    return (split_join(both, least, ["a"], "_n", "b").filter("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = least_of(down)
    return (split_join(down, least, ["a"], "_n", "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge ``(a, b)``; the root is the smallest node.

    Alternating star steps need a number of rounds that grows with the logarithm
    of the graph, not with its diameter, and never gather a neighbourhood: the
    smallest neighbour is a partial aggregate, and the edges of a node with very
    many, as the root of a large component has, are dealt to several tasks. Each
    round is materialised.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before, now = None, mark(edges)
    while now != before and now[0]:
        edges = cut(small_star(large_star(edges).distinct()).distinct(), replaces=edges)
        before, now = now, mark(edges)
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
