"""Connected parts of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.llm.staging import settle


def connected(edges: DataFrame) -> DataFrame:
    """(node, part) for each node of ``edges`` (a, b); ``part`` is the smallest node of its part.

    Each step hangs the larger neighbours of a node, then the smaller ones, on the smallest of
    them. The number of steps grows with the logarithm of the longest path, and no step holds the
    neighbours of a node together: they meet only in a minimum.
    """
    current = _ordered(edges.select("a", "b"))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours go to the smallest node around.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small_least, "a")
        small = hung.select("b", "m").unionByName(hung.select(F.col("a").alias("b"), "m"))
        after = settle(_ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        # Done when all hang on a root: no node has two edges, or is the end of one and has another.
        ends = after.select("a", F.lit(1).alias("own")).unionByName(after.select(F.col("b").alias("a"), F.lit(0).alias("own")))
        if ends.groupBy("a").agg(F.sum("own").alias("own"), F.min("own").alias("least")).filter("own > 1 or (own = 1 and least = 0)").isEmpty():
            break
        current = after
    roots = after.select(F.col("b").alias("node")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(
        roots.select("node", F.col("node").alias("part")))


def joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (as from ``connected``) with more ``edges``: only the parts that these link are looked at anew."""
    of = parts.select("node", "part")
    ends = edges.select("a", "b").join(of.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a", "left").join(
        of.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b", "left")
    linked = connected(ends.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
    moved = linked.select(F.col("node").alias("part"), F.col("part").alias("now"))
    kept = of.join(moved, "part", "left").select("node", F.coalesce("now", "part").alias("part"))
    return settle(kept.unionByName(linked.join(of.select("node"), "node", "left_anti").select("node", "part")))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge between two nodes once, with the smaller one as b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
