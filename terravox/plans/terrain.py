"""Terrain pipelines from a configuration: an ordered list of blocks that add layers to a map.

Each block names the layers that it reads; a missing one is an error when the plan is built, before any job runs.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import kernel
from ..operators import columns, stencil


def load_config(path: str) -> dict:
    """A YAML file; !include puts in another, relative to the first."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!include", lambda loader, node: load_config(os.path.join(os.path.dirname(path), loader.construct_scalar(node))))
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Loader)  # noqa: S506 - a SafeLoader


def _taps(p: dict, resolution: float):
    return kernel(p["kernel_type"], p["radius"], resolution, p.get("sharpness", 1.0))


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"gx": "i", "gy": "j"})


def _joined(bev: DataFrame | None, layers: DataFrame) -> DataFrame:
    return _cells(layers) if bev is None else bev.join(_cells(layers), ["i", "j"], "left")


def normals_pca(cells: DataFrame, layer: str, resolution: float) -> DataFrame:
    """Normal of each 3 x 3 patch: the axis of least variance, upwards. Absent neighbours are zeros.

    Moments come from one scatter; only the 3 x 3 eigenvectors are worked out in numpy, a batch at a time.
    """
    box = kernel("box", resolution, resolution)
    z = F.col(layer)
    at = cells.select("i", "j", z.alias("z"))
    at = stencil.scatter(at, box, {"s": F.col("z"), "q": F.col("z") ** 2})
    at = stencil.scatter(at, [(i, j, float(i)) for i, j, _ in box if i], {"a": F.col("z")})
    at = stencil.scatter(at, [(i, j, float(j)) for i, j, _ in box if j], {"b": F.col("z")})

    def axes(batches):
        for p in batches:
            m = np.zeros((len(p), 3, 3))
            m[:, 0, 0] = m[:, 1, 1] = 6 * resolution**2 / 9
            m[:, 0, 2] = m[:, 2, 0] = p["a"] * resolution / 9
            m[:, 1, 2] = m[:, 2, 1] = p["b"] * resolution / 9
            m[:, 2, 2] = p["q"] / 9 - (p["s"] / 9) ** 2
            n = np.linalg.eigh(m)[1][:, :, 0]
            n = n * np.where(n[:, 2:] < 0, -1, 1)
            yield pd.DataFrame({"i": p["i"], "j": p["j"], "normal_x": n[:, 0].round(6), "normal_y": n[:, 1].round(6), "normal_z": n[:, 2].round(6)})

    return at.mapInPandas(axes, "i long, j long, normal_x double, normal_y double, normal_z double")


#: Block: (layers that it reads, by its parameters; what it does to (map, voxels, parameters, resolution)).
BLOCKS: dict[str, tuple[Callable[[dict], list[str]], Callable]] = {
    "elevation_stats": (lambda p: [], lambda bev, vox, p, r: _joined(bev, columns.elevation_stats(vox, F.col("cz")))),
    "porosity": (lambda p: [], lambda bev, vox, p, r: _joined(bev, columns.porosity(vox, p.get("reduce", "mean")))),
    "bev_feature_splat": (lambda p: [], lambda bev, vox, p, r: _joined(bev, columns.feature_splat(vox, p["features"]))),
    "elevation_filter": (
        lambda p: [p["input_layer"], p["cnt_layer"]],
        lambda bev, vox, p, r: stencil.elevation_filter(bev, p["input_layer"], F.col(p["cnt_layer"]) > 1e-4, _taps(p["kernel_params"], r), p["height_low_thresh"], p["height_high_thresh"]),
    ),
    "terrain_inflation": (lambda p: [p["input_layer"], p["mask_layer"]], lambda bev, vox, p, r: stencil.inflate(bev, p["input_layer"], p["mask_layer"], _taps(p["kernel_params"], r), p["thresh"])),
    "mrf_terrain_estimation": (
        lambda p: [p["input_layer"], p["mask_layer"]],
        lambda bev, vox, p, r: stencil.smooth(bev, p["input_layer"], p["mask_layer"], _taps(p["kernel_params"], r), p["itrs"], p["alpha"], p["beta"], p["lr"], p.get("output_layer", "terrain")),
    ),
    "slope": (lambda p: [p["input_layer"], p["mask_layer"]], lambda bev, vox, p, r: stencil.slope(bev, p["input_layer"], p["mask_layer"], p.get("kernel_type", "scharr"), p["radius"], r, p.get("max_slope", 1e10))),
    "normals_sobel": (lambda p: ["slope_x", "slope_y"], lambda bev, vox, p, r: stencil.normals(bev, p.get("mask_layer"))),
    "normals_pca": (lambda p: [p["terrain_layer"]], lambda bev, vox, p, r: bev.join(normals_pca(bev, p["terrain_layer"], r), ["i", "j"])),
    "bev_terrain_diff": (
        lambda p: [p["terrain_layer"], p["max_elevation_layer"]],
        lambda bev, vox, p, r: bev.withColumn("diff", F.greatest(F.lit(0.0), F.least(F.lit(p["overhang"]), F.col(p["max_elevation_layer"]) - F.col(p["terrain_layer"])))),
    ),
    "terrain_diff": (
        lambda p: [p["terrain_layer"]],
        lambda bev, vox, p, r: bev.join(_cells(columns.terrain_diff(vox, bev.select(F.col("i").alias("gx"), F.col("j").alias("gy"), F.col(p["terrain_layer"]).alias("terrain")), F.col("cz"), p["overhang"])), ["i", "j"], "left"),
    ),
    "terrain_aware_bev_feature_splat": (
        lambda p: [p["terrain_layer"]],
        lambda bev, vox, p, r: bev.join(_cells(columns.terrain_splat(vox, bev.select(F.col("i").alias("gx"), F.col("j").alias("gy"), F.col(p["terrain_layer"]).alias("terrain")), F.col("cz"), p["features"], p["overhang"], p.get("reduce", "mean"))), ["i", "j"], "left"),
    ),
    "sdf": (lambda p: [p["mask_layer"]], lambda bev, vox, p, r: bev.join(stencil.signed_distance(bev, F.col(p["mask_layer"]) > p["thresh"], r), ["i", "j"], "left")),
}

#: The order that ships with the main preset.
DEFAULT = [
    {"type": "elevation_stats"},
    {"type": "elevation_filter", "input_layer": "min_elevation", "cnt_layer": "num_voxels", "kernel_params": {"kernel_type": "gaussian", "radius": 2.0, "sharpness": 5.0}, "height_low_thresh": -3.0, "height_high_thresh": 0.5},
    {"type": "terrain_inflation", "input_layer": "min_elevation_filtered", "mask_layer": "min_elevation_filtered_mask", "kernel_params": {"kernel_type": "gaussian", "radius": 2.0, "sharpness": 2.0}, "thresh": 0.05},
    {"type": "mrf_terrain_estimation", "input_layer": "min_elevation_filtered_inflated", "mask_layer": "min_elevation_filtered_inflated_mask", "itrs": 2, "alpha": 10.0, "beta": 1.0, "lr": 0.05, "kernel_params": {"kernel_type": "gaussian", "radius": 1.0, "sharpness": 2.0}},
    {"type": "slope", "input_layer": "terrain", "mask_layer": "min_elevation_filtered_inflated_mask", "radius": 1.0, "kernel_type": "scharr", "max_slope": 2.0},
    {"type": "normals_sobel"},
    {"type": "bev_terrain_diff", "terrain_layer": "terrain", "max_elevation_layer": "max_elevation", "overhang": 2.0},
    {"type": "porosity"},
]


def run(blocks: list[dict], voxels: DataFrame, resolution: float, bev: DataFrame | None = None) -> DataFrame:
    """The map after all blocks. voxels need cz, the height of their centres."""
    for spec in blocks:
        p = {k: v for k, v in spec.items() if k != "type"}
        if spec["type"] not in BLOCKS:
            raise ValueError(f"unknown block {spec['type']}")
        reads, apply = BLOCKS[spec["type"]]
        missing = [x for x in reads(p) if bev is None or x not in bev.columns]
        if missing:
            raise ValueError(f"{spec['type']} needs layers {missing}")
        bev = apply(bev, voxels, p, resolution)
    return bev


def wave(spark, n: int, height: float, kx: float, ky: float) -> DataFrame:
    """A made-up map of n x n cells of one metre, height * sin(kx i) cos(ky j), with its true slopes."""
    at = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    x, y = kx * F.col("i"), ky * F.col("j")
    return at.select("i", "j", (height * F.sin(x) * F.cos(y)).alias("z"), (height * kx * F.cos(x) * F.cos(y)).alias("slope_x"), (-height * ky * F.sin(x) * F.sin(y)).alias("slope_y"))
