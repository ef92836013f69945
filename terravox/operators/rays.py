"""Spherical binning and the misses that rays leave in the voxels they pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import from_spherical, quaternion_matrix, to_spherical
from ..sources.working import written


#: Elevations in degrees of the beams of a 32-beam sensor, and how far above a beam's lower edge a return may lie.
BEAMS = (
    -25.0, -15.639, -11.31, -8.843, -7.254, -6.148, -5.333, -4.667, -4.0, -3.667, -3.333, -3.0, -2.667, -2.333, -2.0, -1.667,
    -1.0, -0.667, -0.333, 0.0, 0.333, 0.667, 1.0, 1.333, 1.667, 2.333, 3.0, 3.333, 4.667, 7.0, 10.333, 15.0, 15.5,
)
BEAM_HEIGHT = 0.5


@dataclass(frozen=True)
class SensorModel:
    """Elevation and azimuth bins in degrees: first edge, last edge and number, or for elevations edges of their own; a residual above a threshold is outside of its bin."""

    el: tuple[float, float, int]
    az: tuple[float, float, int]
    el_threshold: float | None = None
    az_threshold: float | None = None
    el_edges: tuple[float, ...] | None = None

    @staticmethod
    def named(kind: str, **config) -> SensorModel:
        if kind == "generic":
            return SensorModel(**config)
        if kind in ("vlp32c", "vlp32c_front"):
            edges = tuple(b - BEAM_HEIGHT / 2 for b in BEAMS)
            around = (-90.0, 90.0, 450) if kind.endswith("front") else (-180.0, 180.0, 900)
            return SensorModel((edges[0], edges[-1], len(edges) - 1), around, BEAM_HEIGHT, None, edges)
        raise ValueError(f"unknown sensor {kind}")

    def bin(self, el: Column, az: Column) -> Column:
        """Number of the bin, or null outside. Bins hold (low, high]."""

        def place(c: Column, spec: tuple[float, float, int], threshold: float | None) -> Column:
            low, high, n = (math.radians(spec[0]), math.radians(spec[1]), spec[2])
            step = (high - low) / n
            at = (F.ceil((c - low) / step) - 1).cast("long")
            residual = c - (low + at * step)
            return F.when((at >= 0) & (at < n) & (residual <= (step if threshold is None else math.radians(threshold)) + 1e-9), at)

        def among(c: Column, edges: tuple[float, ...], threshold: float) -> Column:
            low = F.array(*(F.lit(math.radians(e)) for e in edges))
            at = F.size(F.filter(low, lambda e: e < c)) - 1
            return F.when((at >= 0) & (at < len(edges) - 1) & (c - F.get(low, at) <= math.radians(threshold) + 1e-9), at).cast("long")

        up = place(el, self.el, self.el_threshold) if self.el_edges is None else among(el, self.el_edges, self.el_threshold)
        return up * self.az[2] + place(az, self.az, self.az_threshold)


def bins_of(model: SensorModel, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SensorModel.bin for places as the sensor sees them, in numpy: numbers of bins (-1 outside) and ranges."""
    flat, out = np.hypot(xyz[:, 0], xyz[:, 1]), []
    for angle, (lo, hi, n), threshold in ((np.arctan2(xyz[:, 2], flat), model.el, model.el_threshold), (np.arctan2(xyz[:, 1], xyz[:, 0]), model.az, model.az_threshold)):
        low, step = math.radians(lo), (math.radians(hi) - math.radians(lo)) / n
        if model.el_edges is not None and not out:
            edges = np.radians(model.el_edges)
            at = np.searchsorted(edges, angle, "left") - 1
            out.append((at, (at >= 0) & (at < n) & (angle - edges[np.maximum(at, 0)] <= math.radians(threshold) + 1e-9)))
            continue
        at = np.ceil((angle - low) / step).astype(np.int64) - 1
        out.append((at, (at >= 0) & (at < n) & (angle - (low + at * step) <= (step if threshold is None else math.radians(threshold)) + 1e-9)))
    (el, seen_el), (az, seen_az) = out
    return np.where(seen_el & seen_az, el * model.az[2] + az, -1), np.sqrt((xyz**2).sum(1))


def local(df: DataFrame, sensor: tuple[float, ...], x: Column, y: Column, z: Column) -> DataFrame:
    """Spherical coordinates as the sensor sees them: from its position and, where a quaternion x, y, z, w follows, turned back by it."""
    at = (x - sensor[0], y - sensor[1], z - sensor[2])
    if len(sensor) == 7:
        turn = quaternion_matrix(*(F.lit(float(c)) for c in sensor[3:]))
        at = tuple(turn[0][k] * at[0] + turn[1][k] * at[1] + turn[2][k] * at[2] for k in range(3))
    return df.withColumns(to_spherical(*at))


def placed(df: DataFrame, sensor: tuple[float, ...], el: Column, az: Column, r: Column) -> DataFrame:
    """The way back from local(): x, y, z of places that a sensor at a position, turned by a quaternion where one follows, sees so."""
    at = tuple(from_spherical(el, az, r)[a] for a in "xyz")
    if len(sensor) == 7:
        turn = quaternion_matrix(*(F.lit(float(c)) for c in sensor[3:]))
        at = tuple(turn[k][0] * at[0] + turn[k][1] * at[1] + turn[k][2] * at[2] for k in range(3))
    return df.withColumns({a: c + s for a, c, s in zip("xyz", at, sensor, strict=False)})


def range_gate(points: DataFrame, sensor: tuple[float, ...], low: float, high: float) -> DataFrame:
    """Points farther from the sensor than low and nearer than high, with their range."""
    far = F.sqrt(sum(((F.col(a) - s) ** 2 for a, s in zip("xyz", sensor, strict=False)), F.lit(0.0)))
    return points.withColumn("range", far).where((F.col("range") > low) & (F.col("range") < high))


def bin_ranges(points: DataFrame, model: SensorModel, sensor: tuple[float, ...], reduce=F.max) -> DataFrame:
    """Range per bin; the table is bounded by the sensor's bins."""
    binned = local(points, sensor, F.col("x"), F.col("y"), F.col("z")).withColumn("bin", model.bin(F.col("el"), F.col("az")))
    return binned.where("bin is not null").groupBy("bin").agg(reduce("range").alias("bin_range"))


def raytrace(voxels: DataFrame, points: DataFrame, model: SensorModel, sensor: tuple[float, ...], centres: dict[str, Column], no_return: float = 200.0, drop_first: bool = True) -> DataFrame:
    """One more miss for voxels whose centre is nearer than what their bin returned.

    Bins without a return count as seen up to no_return; bin 0 never has one (drop_first).
    """
    ranges = bin_ranges(points, model, sensor)
    ranges = ranges.where("bin > 0") if drop_first else ranges
    at = local(voxels.withColumns({f"_{k}": v for k, v in centres.items()}), sensor, *(F.col(f"_{k}") for k in centres)).withColumn("bin", model.bin(F.col("el"), F.col("az")))
    seen = at.join(F.broadcast(ranges), "bin", "left")
    passed = F.col("bin").isNotNull() & (F.col("range") < F.coalesce(F.col("bin_range"), F.lit(no_return)))
    return seen.withColumn("misses", F.col("misses") + passed.cast("double")).drop("bin", "bin_range", "el", "az", "range", *(f"_{k}" for k in centres))


def render(voxels: DataFrame, model: SensorModel, sensor: tuple[float, ...], centres: dict[str, Column], layers: list[str]) -> DataFrame:
    """Depth image: per bin the nearest voxel's range and the mean of its layers (of all within 1e-6 of it)."""
    at = local(voxels.withColumns({f"_{k}": v for k, v in centres.items()}), sensor, *(F.col(f"_{k}") for k in centres)).withColumn("bin", model.bin(F.col("el"), F.col("az"))).where("bin is not null")
    near = at.withColumn("_r", F.round("range", 6)).groupBy("bin", "_r").agg(F.min("range").alias("depth"), *(F.avg(c).alias(c) for c in layers))
    return near.groupBy("bin").agg(F.min_by(F.struct("depth", *layers), "_r").alias("s")).select("bin", "s.*")


def splat(voxels: DataFrame, model: SensorModel, sensor: tuple[float, ...], centres: dict[str, Column], resolution: tuple[float, ...], layers: list[str], steps: int = 5) -> DataFrame:
    """Depth and colour image: per bin the range of the nearest sub-point, and its voxel's layers scaled to 0 .. 1.

    Voxels nearest in their bin (all within 1e-6) become steps^3 sub-points over one cell from the given place on, which are
    binned again. Of a bin's sub-points the nearest gives the colour (of those within 1e-6 the mean), so the image hangs on no order;
    sub-points out of view give nothing. Layers are scaled by their least and greatest value over all voxels given;
    a layer without span is 0. At most the voxels of one view, which the sensor's bins bound, are spread. The voxels, which are
    asked for three times, are written once.
    """
    voxels = written(voxels, "splat")
    named = {f"_{k}": v for k, v in centres.items()}
    at = local(voxels.withColumns(named), sensor, *(F.col(k) for k in named)).withColumn("bin", model.bin(F.col("el"), F.col("az"))).where("bin is not null")
    least = at.groupBy("bin").agg(F.min("range").alias("_least"))
    front = at.join(F.broadcast(least), "bin").where(F.abs(F.col("range") - F.col("_least")) < 1e-6).select(*named, *layers)
    shares = [k / (steps - 1) if steps > 1 else 0.0 for k in range(steps)]
    for k, r in zip(named, resolution, strict=True):
        front = front.withColumn("_o", F.explode(F.array(*(F.lit(s * r) for s in shares)))).withColumn(k, F.col(k) + F.col("_o")).drop("_o")
    seen = local(front, sensor, *(F.col(k) for k in named)).withColumn("bin", model.bin(F.col("el"), F.col("az"))).where("bin is not null")
    ties = seen.groupBy("bin", F.round("range", 6).alias("_r")).agg(F.min("range").alias("depth"), *(F.avg(c).alias(c) for c in layers))
    image = ties.groupBy("bin").agg(F.min_by(F.struct("depth", *layers), "_r").alias("s")).select("bin", "s.*")
    spans = voxels.agg(*(f(c).alias(f"_{n}_{c}") for c in layers for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)), F.lit(0.0)) for c in layers}
    return image.crossJoin(F.broadcast(spans)).select("bin", "depth", *(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(c) for c, v in scaled.items()))
