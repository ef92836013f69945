"""Aggregations of voxel columns and of points into map cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridMeta
from .voxel import folded

CELL = ("gx", "gy")
#: Reducers by name.
REDUCE = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def elevation_stats(voxels: DataFrame, z: Column) -> DataFrame:
    """Lowest, mean and highest height and number of voxels of each column."""
    return voxels.withColumn("_z", z).groupBy(*CELL).agg(F.min("_z").alias("min_elevation"), F.avg("_z").alias("mean_elevation"), F.max("_z").alias("max_elevation"), F.count(F.lit(1)).alias("num_voxels"))


def porosity(voxels: DataFrame, reduce: str = "mean") -> DataFrame:
    """Share of rays that passed: misses / (hits + misses), reduced over each column."""
    passed = F.col("misses") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0.0))
    return voxels.groupBy(*CELL).agg(REDUCE[reduce](passed).alias("porosity"))


def feature_splat(voxels: DataFrame, features: list[str], reduce: str = "mean") -> DataFrame:
    """Each feature reduced over the column's voxels that have it."""
    return voxels.where(F.col(features[0]).isNotNull()).groupBy(*CELL).agg(*(REDUCE[reduce](f).alias(f) for f in features))


def terrain_splat(voxels: DataFrame, terrain: DataFrame, centre: Column, features: list[str], overhang: float, reduce: str = "mean") -> DataFrame:
    """Splat of voxels whose centre lies below terrain + overhang, over cells with known terrain."""
    near = voxels.withColumn("_c", centre).join(terrain, list(CELL)).where(F.col("_c") < F.col("terrain") + overhang)
    return feature_splat(near, features, reduce)


def terrain_diff(voxels: DataFrame, terrain: DataFrame, centre: Column, overhang: float) -> DataFrame:
    """Height of the highest voxel above the terrain, below the overhang; cells without one are 0."""
    above = voxels.withColumn("_c", centre).join(terrain, list(CELL), "right").withColumn("_d", F.col("_c") - F.col("terrain"))
    highest = F.max(F.when(F.col("_d") < overhang, F.col("_d")))
    return above.groupBy(*CELL).agg(F.greatest(F.lit(0.0), F.least(F.lit(overhang), F.coalesce(highest, F.lit(0.0)))).alias("diff"))


def bev_from_points(points: DataFrame, meta: GridMeta, features: list[str], per: tuple[str, ...] = ()) -> DataFrame:
    """Mean features and number of points per cell, or per scan and cell; points with features alone count."""
    inside = points.withColumns(meta.dims(0, 1).keys()).where(meta.dims(0, 1).contains_keys())
    return inside.where(F.col(features[0]).isNotNull()).groupBy(*per, *CELL).agg(*(F.avg(f).alias(f) for f in features), F.count(F.lit(1)).alias("hits"))


def elevation_grid(points: DataFrame, meta: GridMeta, per: tuple[str, ...] = ()) -> DataFrame:
    inside = points.withColumns(meta.dims(0, 1).keys()).where(meta.dims(0, 1).contains_keys())
    return inside.groupBy(*per, *CELL).agg(F.min("z").alias("min_elevation"), F.max("z").alias("max_elevation"), F.count(F.lit(1)).alias("hits"))


def below_overhang(points: DataFrame, grid: DataFrame, meta: GridMeta, overhang: float) -> DataFrame:
    """Points lower than their cell's lowest height + overhang; unknown cells and points outside keep all."""
    known = points.withColumns(meta.dims(0, 1).keys()).join(grid.select(*CELL, "min_elevation"), list(CELL), "left")
    return known.where(F.col("z") < F.coalesce(F.col("min_elevation"), F.lit(1e10)) + overhang).drop("min_elevation")


def below_remembered(points: DataFrame, meta: GridMeta, overhang: float, order: str) -> DataFrame:
    """below_overhang of every scan against the lowest heights of the scans before it; the window has one row per scan and cell."""
    keyed = points.withColumns(meta.dims(0, 1).keys())
    lows = keyed.where(meta.dims(0, 1).contains_keys()).groupBy(order, *CELL).agg(F.min("z").alias("_z"))
    before = Window.partitionBy(*CELL).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = keyed.join(lows.select(order, *CELL, F.min("_z").over(before).alias("_low")), [order, *CELL], "left")
    return known.where(F.col("z") < F.coalesce(F.col("_low"), F.lit(1e10)) + overhang).drop("_low")


def fold_elevation(grids: DataFrame, overhang: float, order: str) -> DataFrame:
    """merge_elevation over all scans in order: a left fold over at most one entry per scan of each cell."""
    seen = F.array_sort(F.collect_list(F.struct(order, F.col("min_elevation").alias("lo"), F.col("max_elevation").alias("hi"))))

    def step(acc: Column, x: Column) -> Column:
        lo = F.least(acc["lo"], x["lo"])
        gone = (acc["hi"] - lo > overhang) & (x["hi"] - x["lo"] < overhang)
        return F.struct(lo.alias("lo"), F.when(gone, x["hi"]).otherwise(F.greatest(acc["hi"], x["hi"])).alias("hi"))

    none = F.struct(*(F.lit(None).cast("double").alias(k) for k in ("lo", "hi")))
    made = grids.groupBy(*CELL).agg(F.aggregate(seen, none, step).alias("_e"), F.sum("hits").alias("hits"))
    return made.select(*CELL, F.col("_e.lo").alias("min_elevation"), F.col("_e.hi").alias("max_elevation"), "hits")


def shift(grid: DataFrame, meta: GridMeta, by: tuple[int, int], fill: dict[str, float]) -> DataFrame:
    """The dense map after its origin has moved by whole cells; cells that come in hold the fill."""
    moved = grid.withColumns({k: F.col(k) - d for k, d in zip(CELL, by, strict=True)}).where(meta.dims(0, 1).contains_keys())
    return meta.dims(0, 1).mesh(grid.sparkSession).select(*CELL).join(moved, list(CELL), "left").na.fill(fill)


def merge_elevation(old: DataFrame, new: DataFrame, overhang: float, cleanup: bool = True) -> DataFrame:
    """Running lowest and highest heights.

    Where what is remembered spans more than the overhang, from the lowest height of both, and the new scan's own heights
    span less, the remembered overhang is gone: the new highest height takes its place.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = lambda c, k: F.max(F.when(F.col("_new") == k, F.col(c)))
    seen = both.groupBy(*CELL).agg(F.min("min_elevation").alias("min_elevation"), pick("max_elevation", 0).alias("_old"), pick("max_elevation", 1).alias("_max"), pick("min_elevation", 1).alias("_min"), F.sum("hits").alias("hits"))
    gone = (F.col("_old") - F.col("min_elevation") > overhang) & (F.col("_max") - F.col("_min") < overhang)
    highest = F.greatest("_old", "_max")
    return seen.select(*CELL, "min_elevation", (F.when(gone, F.col("_max")).otherwise(highest) if cleanup else highest).alias("max_elevation"), "hits")


def merge_features(old: DataFrame, new: DataFrame, features: list[str], alpha: float) -> DataFrame:
    """Moving average of the cells' features; hits add up."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = lambda f, k: F.max(F.when(F.col("_new") == k, F.col(f)))
    return both.groupBy(*CELL).agg(*(F.coalesce(pick(f, 0) * (1 - alpha) + pick(f, 1) * alpha, pick(f, 1), pick(f, 0)).alias(f) for f in features), F.sum("hits").alias("hits"))


def fold_features(grids: DataFrame, features: list[str], alpha: float, order: str) -> DataFrame:
    """merge_features over all scans in order: one shuffle, a left fold over at most one entry per scan of each cell."""
    made = grids.groupBy(*CELL).agg(folded(features, alpha, order).alias("_f"), F.sum("hits").alias("hits"))
    return made.select(*CELL, *(F.col(f"_f.{f}").alias(f) for f in features), "hits")


def densify(grid: DataFrame, meta: GridMeta, fill: float = 0.0) -> DataFrame:
    """All cells of the map; layers of absent ones are `fill`. The mesh is bounded by the map's size."""
    layers = [c for c in grid.columns if c not in CELL]
    return meta.dims(0, 1).mesh(grid.sparkSession).select(*CELL).join(grid, list(CELL), "left").na.fill(fill, layers)


def bev_map(elevation: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Elevation, features and both counts side by side."""
    left = elevation.withColumnRenamed("hits", "num_points")
    return left.join(features.withColumnRenamed("hits", "num_feature_points"), list(CELL), "left").na.fill(0, [*names, "num_feature_points"])


def grid_map(cells: DataFrame, layers: list[str], rows: int, cols: int, inside: Column, constant: dict[str, float]) -> DataFrame:
    """Rows (layer, values) as a map message stores them: both axes turned round, columns first; NaN outside the mask, null where there is no cell.

    cells: i, j and the layers; constant layers are the same everywhere. An array has rows x cols entries, which the map bounds.
    """
    nan = F.lit(float("nan"))
    masked = {c: F.when(inside, F.col(c).cast("double")).otherwise(nan) for c in layers} | {c: F.lit(float(v)) for c, v in constant.items()}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("layer"), v.alias("v")) for c, v in masked.items())))
    place = (cols - 1 - F.col("j")) * rows + (rows - 1 - F.col("i"))
    held = cells.select(place.cast("int").alias("_p"), each.alias("_e")).groupBy("_e.layer").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_e.v"))).alias("_m"))
    return held.select("layer", F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda p: F.try_element_at("_m", p)).alias("values"))
