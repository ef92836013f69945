"""Sparse voxel tables: one row per key (gx, gy, gz) with features, bounds, evidence and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, KEYS, GridMeta


def keyed(points: DataFrame, meta: GridMeta) -> DataFrame:
    """Points inside the box with their keys. The box is tested on the raw columns too, so that scans can prune."""
    return points.where(meta.contains_points()).withColumns(meta.keys()).where(meta.contains_keys())


def mean_features(points: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature over a voxel's points that have features."""
    return points.where(F.col(features[0]).isNotNull()).groupBy(*KEYS).agg(*(F.avg(f).alias(f) for f in features))


def nearest_features(points: DataFrame, features: list[str], sensor: tuple[float, ...], per: tuple[str, ...] = ()) -> DataFrame:
    """Features of the point nearest to the sensor, exact ties averaged.

    One aggregation of (distance, sums) pairs: min_by keeps the nearest distance's sums, as ties are summed first.
    """
    distance = sum(((F.col(a) - F.lit(s)) ** 2 for a, s in zip(AXES, sensor, strict=True)), F.lit(0.0))
    at = points.where(F.col(features[0]).isNotNull()).withColumn("_d", distance).groupBy(*per, *KEYS, "_d").agg(*(F.sum(f).alias(f) for f in features), F.count(F.lit(1)).alias("_n"))
    best = at.groupBy(*per, *KEYS).agg(F.min_by(F.struct(*features, "_n"), "_d").alias("_b"))
    return best.select(*per, *KEYS, *((F.col(f"_b.{f}") / F.col("_b._n")).alias(f) for f in features))


def bounds(points: DataFrame, stamp: Column, per: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """hits 1 and misses 0 per scan, bounds of the points, times of the scan."""
    lows = [F.min(a).alias(f"min_{a}") for a in AXES] + [F.max(a).alias(f"max_{a}") for a in AXES]
    return points.groupBy(*per, *KEYS).agg(F.lit(1.0).alias("hits"), F.lit(0.0).alias("misses"), *lows, F.min(stamp).alias("first_update"), F.max(stamp).alias("last_update"), *more)


def voxelize(points: DataFrame, meta: GridMeta, features: list[str], stamp: Column, strategy: str = "mindist", sensor: tuple[float, ...] = (0.0, 0.0, 0.0), per: tuple[str, ...] = ()) -> DataFrame:
    """Voxel table of one scan, or of each scan that the columns `per` tell apart."""
    inside = keyed(points, meta)
    if strategy == "mindist":
        return bounds(inside, stamp, per).join(nearest_features(inside, features, sensor, per), [*per, *KEYS], "left")
    return bounds(inside, stamp, per, *(F.avg(f).alias(f) for f in features))


def merge(old: DataFrame, new: DataFrame, features: list[str], alpha: float) -> DataFrame:
    """Upsert of a scan into the state: one shuffle on the key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = lambda f, k: F.max(F.when(F.col("_new") == k, F.col(f)))
    blended = [F.coalesce(pick(f, 0) * (1 - alpha) + pick(f, 1) * alpha, pick(f, 1), pick(f, 0)).alias(f) for f in features]
    lows = [F.min(f"min_{a}").alias(f"min_{a}") for a in AXES] + [F.max(f"max_{a}").alias(f"max_{a}") for a in AXES]
    return both.groupBy(*KEYS).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), *lows, F.min("first_update").alias("first_update"), F.max("last_update").alias("last_update"), *blended)


def folded(features: list[str], alpha: float, order: str) -> Column:
    """Aggregate: struct of each feature's moving average over the group's rows, in order; a row without it changes nothing."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(order), *features)))
    step = lambda acc, x: F.struct(*(F.coalesce(acc[f] * (1 - alpha) + x[f] * alpha, x[f], acc[f]).alias(f) for f in features))
    none = F.struct(*(F.lit(None).cast("double").alias(f) for f in features))
    return F.aggregate(seen, none, step)


def fold(scans: DataFrame, features: list[str], alpha: float, order: str) -> DataFrame:
    """Moving average of each voxel over its scans, in their order: a left fold over at most one entry per scan."""
    made = scans.groupBy(*KEYS).agg(folded(features, alpha, order).alias("_f"), F.count(F.lit(1)).alias("n_scans"))
    return made.select(*KEYS, "n_scans", *(F.col(f"_f.{f}").alias(f) for f in features))


def merge_all(scans: DataFrame, features: list[str], alpha: float, order: str) -> DataFrame:
    """merge of all scans in order, at once: one shuffle, whatever their number."""
    lows = [F.min(f"min_{a}").alias(f"min_{a}") for a in AXES] + [F.max(f"max_{a}").alias(f"max_{a}") for a in AXES]
    made = scans.groupBy(*KEYS).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), *lows, F.min("first_update").alias("first_update"), F.max("last_update").alias("last_update"), folded(features, alpha, order).alias("_f"))
    return made.select("*", *(F.col(f"_f.{f}").alias(f) for f in features)).drop("_f")


def cull(voxels: DataFrame, share: float = 0.75) -> DataFrame:
    """Without voxels that rays mostly passed through, but never the lowest of a column."""
    lowest = F.min("gz").over(Window.partitionBy("gx", "gy"))
    passed = F.col("misses") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0.0))
    return voxels.withColumn("_low", lowest).where((F.coalesce(passed, F.lit(0.0)) <= share) | (F.col("gz") == F.col("_low"))).drop("_low")


def crop(voxels: DataFrame, old: GridMeta, new: GridMeta) -> DataFrame:
    """Re-keyed to another origin of the same resolution, without what lies outside; also the shift of a moving box."""
    moved = {k: F.col(k) - F.lit(round((b - a) / r)) for k, a, b, r in zip(KEYS, old.origin, new.origin, old.resolution, strict=True)}
    return voxels.withColumns(moved).where(new.contains_keys())


def midpoints(voxels: DataFrame) -> DataFrame:
    return voxels.withColumns({f"mid_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in AXES})


def replace_features(voxels: DataFrame, old: list[str], new: dict[str, Column]) -> DataFrame:
    return voxels.withColumns({f"_{k}": c for k, c in new.items()}).drop(*old).withColumnsRenamed({f"_{k}": k for k in new})


def broken(voxels: DataFrame, meta: GridMeta) -> DataFrame:
    """Rows that break an invariant: keys unique and inside, bounds and times in order, evidence not negative."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*KEYS)) > 1
    wrong = ~meta.contains_keys() | (F.col("first_update") > F.col("last_update")) | (F.col("hits") < 0) | (F.col("misses") < 0)
    for a in AXES:
        wrong = wrong | (F.col(f"min_{a}") > F.col(f"max_{a}"))
    return voxels.withColumn("_twice", twice).where(wrong | F.col("_twice")).drop("_twice")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Numbers of keys in both, in a alone and in b alone: one aggregation of the union."""
    sides = a.select(*KEYS, F.lit(1).alias("s")).unionByName(b.select(*KEYS, F.lit(2).alias("s"))).groupBy(*KEYS).agg(F.bit_or("s").alias("s"))
    return sides.agg(*(F.count(F.when(F.col("s") == k, 1)).alias(name) for name, k in (("both", 3), ("only_a", 1), ("only_b", 2))))


def only_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in exactly one of two tables."""
    sides = a.select(*KEYS, F.lit(1).alias("s")).unionByName(b.select(*KEYS, F.lit(2).alias("s"))).groupBy(*KEYS).agg(F.bit_or("s").alias("side"))
    return sides.where("side <> 3")


def sides_in_turn(scans: DataFrame, order: str) -> DataFrame:
    """Keys of each scan and the next by number: side 1 only in the first, 2 only in the next, 3 in both."""
    seen = scans.select(order, *KEYS).distinct()
    pairs = seen.select(order).distinct()
    pairs = pairs.join(pairs.select((F.col(order) - 1).alias(order)), order, "left_semi")
    both = seen.withColumn("side", F.lit(1)).unionByName(seen.withColumns({order: F.col(order) - 1, "side": F.lit(2)}))
    return both.groupBy(order, *KEYS).agg(F.bit_or("side").alias("side")).join(pairs, order, "left_semi")


def overlaps_in_turn(scans: DataFrame, order: str) -> DataFrame:
    """overlap of each scan with the next."""
    return sides_in_turn(scans, order).groupBy(order).agg(*(F.count(F.when(F.col("side") == k, 1)).alias(name) for name, k in (("both", 3), ("only_a", 1), ("only_b", 2))))
