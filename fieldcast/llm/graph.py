"""Connected components of a link table by alternating star contraction, each round written as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node and the node itself to the least of them (a < b holds)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; ``root`` is the least node of its component.

    The rounds take about the logarithm of the longest path.  Their joins carry one row per link and side against one row per
    node, so the links of a node with very many of them may be split over tasks.
    """
    state = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        state = cut(_small(_large(state)))
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(state.select("a", "a").distinct())
