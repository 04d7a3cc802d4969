"""Connected components of an edge table, with tables only: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges up to which labels of nodes are broadcast (16 bytes each, two nodes an edge), and the
#: files that so few are written to; beyond it nodes meet in joins that can be split.
BROADCAST_EDGES, SMALL_FILES = 300_000, 8


def _hung(pairs: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours ``(a, b, m)`` with the smallest of node and neighbours, and ``(a, m)`` alone.

    The minimum is combined in the tasks before the shuffle.  With few nodes the minima are
    broadcast, so the neighbours of a node with very many of them don't meet in a task.
    """
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return pairs.join(F.broadcast(least) if few else least, "a"), least


def _round(edges: DataFrame, few: bool) -> DataFrame:
    """A large star, which hangs the larger neighbours of each node under its smallest, then a small star for the others."""
    near, _ = _hung(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
    large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    near, least = _hung(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), few)
    small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of the edges ``(a, b)``; comp is the smallest node of its component.

    Each step is a grouped minimum, combined in the tasks before the shuffle, and a join
    by broadcast or one that can be split where a node has very many neighbours.  Steps go
    on until the edges are stars; every step shortens what is not one, and adds no edge.
    """
    first = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    few = first.count() <= BROADCAST_EDGES
    held = lambda df, name: materialise(df.coalesce(SMALL_FILES) if few else df, name)
    current = first.coalesce(SMALL_FILES) if few else first
    while True:
        tops = current.select(F.col("b").alias("a"))
        chained = current.join(F.broadcast(tops) if few else tops.distinct(), "a", "left_semi").select("a")
        forked = current.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("a")
        if chained.union(forked).isEmpty():
            break  # stars: everything points once, at what points nowhere
        current = held(_round(current, few), "cc")
    tops = current.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return held(current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).union(tops), "cc-out")
