"""Made-up grids by seed: equal seeds give equal rows on any cluster, since all values hang on a row's number alone."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import KEYS, GridMeta


def meta(dims: int, seed: int) -> GridMeta:
    """Origin in (-10, 0], resolution in [0.5, 1.5), 1 to 39 cells a side."""
    rng = np.random.default_rng(seed)
    resolution = rng.uniform(0.5, 1.5, dims)
    return GridMeta(tuple((rng.random(dims) * -10).tolist()), tuple((resolution * rng.integers(1, 40, dims)).tolist()), tuple(resolution.tolist()))


def uniform(seed: int, name: str) -> Column:
    """A number in [0, 1) of a row's id, apart for each name."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 53)) / float(1 << 53)


def normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, f"{name}/r"))) * F.cos(2 * math.pi * uniform(seed, f"{name}/t"))


def _features(seed: int, n: int, known: Column | None = None) -> list[Column]:
    value = lambda k: normal(seed, f"f{k}")
    return [(value(k) if known is None else F.when(known, value(k))).alias(f"rand_{k}") for k in range(n)]


def _evidence(seed: int) -> list[Column]:
    return [F.floor(10 * uniform(seed, c)).cast("double").alias(c) for c in ("hits", "misses")]


def voxels(spark: SparkSession, grid: GridMeta, features: int, seed: int) -> DataFrame:
    """Half of a grid's voxels, spread by a step without common factor; the half of them with features."""
    cells = math.prod(grid.n)
    step = next(s for s in range(max(1, int(cells * 0.618)), 2 * cells + 2) if math.gcd(s, cells) == 1)
    made = spark.range(cells // 2).withColumn("_raster", (F.col("id") * step + seed) % cells)
    at = made.withColumns(grid.from_raster(F.col("_raster")))
    first = uniform(seed, "first")
    return at.select(*KEYS, *_features(seed, features, F.col("id") < cells // 4), *_evidence(seed), first.alias("first_update"), (first + uniform(seed, "last")).alias("last_update"))


def bev(spark: SparkSession, grid: GridMeta, features: int, seed: int) -> DataFrame:
    """Every cell of a map with features of normal spread."""
    ni, nj = grid.n
    at = spark.range(ni * nj).withColumns({"i": F.floor(F.col("id") / nj).cast("long"), "j": (F.col("id") % nj).cast("long")})
    return at.select("i", "j", *_features(seed, features), *_evidence(seed))
