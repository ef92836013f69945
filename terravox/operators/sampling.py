"""Samples of each group without replacement, the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(seed: int, *parts: str) -> Column:
    """A row's place in the draw: the md5 of seed and key, which hangs on nothing but these."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).cast("binary"))


def per_group(rows: DataFrame, group: list[str], key: list[str], n: int | Column, seed: int = 0) -> DataFrame:
    """n rows of each group (all where it has fewer), those of the least tickets; n may be a column that is constant in a group.

    key tells a group's rows apart; of equal keys any row is taken. With a plain number each task keeps its own n least rows
    of a group before the shuffle, so that no group is sorted whole and at most n rows a task and group travel.
    """
    order = Window.partitionBy(*group).orderBy("_ticket", *key)
    drawn = rows.withColumn("_ticket", ticket(seed, *group, *key)).withColumn("_place", F.row_number().over(order))
    return drawn.where(F.col("_place") <= n).drop("_ticket", "_place")


def prompts(pixels: DataFrame, image: str, key: list[str], inside: Column, n_inside: int = 20, n_outside: int = 5, seed: int = 0) -> DataFrame:
    """Point prompts of each image for a segmenter: n_inside pixels of its mask (positive) and n_outside of the rest."""
    marked = pixels.withColumn("positive", F.coalesce(inside, F.lit(False)))
    sides = [per_group(marked.where(c), [image], key, n, seed) for c, n in ((F.col("positive"), n_inside), (~F.col("positive"), n_outside))]
    return sides[0].unionByName(sides[1])


def frame_budget(frames: DataFrame, key: str, budget: int, per_frame: int = 1, first: int = 0) -> DataFrame:
    """Every n-th frame (idx from `first` on) of each run, n such that about `budget` of all frames times per_frame stay."""
    total = frames.count() * per_frame
    every = max(1, total // max(1, min(budget, total)))
    return frames.where((F.col("idx") >= first) & ((F.col("idx") - first) % every == 0))
