"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours to the smallest of them and itself: larger ones only, or smaller ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(lowest, "a")
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether each node has one edge at most, to a node that has none: stars around the smallest of each component."""
    from_ = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return from_.where("n > 1").isEmpty() and edges.join(from_.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for every id of an edge (a, b): root is the smallest id that its links reach.

    The number of rounds grows with the logarithm of the longest path. Nothing but whether to go on reaches the driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    while not _starred(now):
        before, now = now, materialize(_star(_star(now, large=True), large=False), "stars")
        discard(before)
    rooted = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), "roots")
    discard(now)
    return rooted
