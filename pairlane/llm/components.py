"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.llm.common import cut


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every node hangs on one node, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)")
    return loose.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one orderable type); root is the smallest node.

    Edges stay as many as they were or become fewer, and nothing is collected: a node's
    smallest neighbour is a grouped minimum (combined before the shuffle), written out and
    joined back on plain exchanges, so a node with very many edges is split like any skewed
    join. Loops and NULL ends are ignored. Rounds go on until all edges are stars; their number
    grows with the logarithm of the longest path, and stars need none.
    """
    now = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        if _settled(now):
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them (no node has many of those now)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
