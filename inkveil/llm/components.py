"""Connected components of a graph of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself go to the least of them. Edges are (a, b) with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """a (long) and component, the least node that links (a, b) reach from it; nodes that are in no link, or the least themselves, aren't listed.

    Each round is written, so that a lost executor costs one round; the rounds grow with the logarithm of the longest path.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        last, edges = edges, written(_small(_large(edges)), "links")
        dropped(last)
        now = print_of(edges)
        if now == before:
            break
        before = now
    out = edges.select("a", F.col("b").alias("component"))
    out._inkveil_path = edges._inkveil_path  # so that it can be dropped
    return out
