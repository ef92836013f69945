"""Grid metadata, origins, kernels and feature schemas: small values on the driver that become literals of a plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
KEYS = ("gx", "gy", "gz")


@dataclass(frozen=True)
class GridMeta:
    """Origin, side lengths and resolution of an n-dimensional grid."""

    origin: tuple[float, ...]
    length: tuple[float, ...]
    resolution: tuple[float, ...]

    @property
    def n(self) -> tuple[int, ...]:
        return tuple(round(a / r) for a, r in zip(self.length, self.resolution, strict=True))

    @property
    def extent(self) -> tuple[tuple[float, float], ...]:
        return tuple((o, o + a) for o, a in zip(self.origin, self.length, strict=True))

    def dims(self, *which: int) -> GridMeta:
        return GridMeta(*(tuple(v[k] for k in which) for v in (self.origin, self.length, self.resolution)))

    def intersects(self, other: GridMeta) -> bool:
        """Closed boxes: touching counts."""
        return all(a <= d and c <= b for (a, b), (c, d) in zip(self.extent, other.extent, strict=True))

    def close_to(self, other: GridMeta, tol: float = 1e-8) -> bool:
        return all(np.allclose(a, b, atol=tol) for a, b in zip((self.origin, self.length, self.resolution), (other.origin, other.length, other.resolution), strict=True))

    def moved(self, pose: tuple[float, ...], base: tuple[float, ...], mode: str = "round") -> GridMeta:
        """Grid whose origin is pose + base, snapped to whole cells: half-to-even for voxels, floor for maps."""
        snap = round if mode == "round" else math.floor
        return GridMeta(tuple(snap((p + b) / r) * r for p, b, r in zip(pose, base, self.resolution, strict=False)), self.length, self.resolution)

    def keys(self) -> dict[str, Column]:
        """Cell of a point, absolute from the origin."""
        return {k: F.floor((F.col(a) - F.lit(o)) / F.lit(r)).cast("long") for k, a, o, r in zip(KEYS, AXES, self.origin, self.resolution, strict=False)}

    def position(self) -> dict[str, Column]:
        """Unrounded place on the grid."""
        return {f"p{a}": (F.col(a) - F.lit(o)) / F.lit(r) for a, o, r in zip(AXES, self.origin, self.resolution, strict=False)}

    def contains_keys(self) -> Column:
        inside = [(F.col(k) >= 0) & (F.col(k) < n) for k, n in zip(KEYS, self.n, strict=False)]
        return inside[0] if len(inside) == 1 else inside[0] & inside[1] if len(inside) == 2 else inside[0] & inside[1] & inside[2]

    def contains_points(self) -> Column:
        out = F.lit(True)
        for a, (lo, hi) in zip(AXES, self.extent, strict=False):
            out = out & (F.col(a) >= lo) & (F.col(a) < hi)
        return out

    def centres(self, half: bool = True) -> dict[str, Column]:
        return {f"c{a}": F.col(k) * F.lit(r) + F.lit(o + (r / 2 if half else 0.0)) for a, k, o, r in zip(AXES, KEYS, self.origin, self.resolution, strict=False)}

    def raster(self) -> Column:
        """Row-major index of a cell."""
        out = F.col(KEYS[0])
        for k, n in zip(KEYS[1:], self.n[1:], strict=False):
            out = out * n + F.col(k)
        return out

    def from_raster(self, raster: Column) -> dict[str, Column]:
        out, rest = {}, raster
        for k, n in reversed(list(zip(KEYS, self.n, strict=False))[1:]):
            out[k] = F.pmod(rest, F.lit(n))
            rest = F.floor(rest / n).cast("long")
        return {KEYS[0]: rest, **out}

    def mesh(self, spark) -> DataFrame:
        """All cells with their lower corners."""
        cells = spark.range(math.prod(self.n)).select(*(c.alias(k) for k, c in self.from_raster(F.col("id")).items()))
        return cells.withColumns(self.centres(half=False))


@dataclass(frozen=True)
class FeatureKeys:
    """Labels of a feature vector with a tag each; equality looks at labels only."""

    label: tuple[str, ...]
    tag: tuple[str, ...]

    def __eq__(self, other) -> bool:
        return self.label == other.label

    def __hash__(self) -> int:
        return hash(self.label)

    def __add__(self, other: FeatureKeys) -> FeatureKeys:
        return FeatureKeys(self.label + other.label, self.tag + other.tag)

    def __len__(self) -> int:
        return len(self.label)

    def __getitem__(self, k: slice) -> FeatureKeys:
        return FeatureKeys(self.label[k], self.tag[k])

    def index(self, label: str) -> int:
        return self.label.index(label)

    def tagged(self, tag: str) -> FeatureKeys:
        kept = [k for k, t in zip(self.label, self.tag, strict=True) if t == tag]
        return FeatureKeys(tuple(kept), (tag,) * len(kept))

    def prefixed(self, prefix: str) -> list[int]:
        return [i for i, k in enumerate(self.label) if k.rsplit("_", 1)[0] == prefix]

    def dumps(self) -> str:
        return "\n".join(f"{a}, {b}" for a, b in zip(self.label, self.tag, strict=True))

    @staticmethod
    def loads(text: str) -> FeatureKeys:
        rows = [line.split(", ") for line in text.splitlines() if line]
        return FeatureKeys(tuple(r[0] for r in rows), tuple(r[1] for r in rows))

    @staticmethod
    def expand(layers: list[dict | str], tag: str) -> FeatureKeys:
        """Labels of {key, n} entries as key_0 .. key_(n-1), plain strings as they are."""
        out = [x if isinstance(x, str) else f"{x['key']}_{i}" for x in layers for i in range(1 if isinstance(x, str) else x["n"])]
        return FeatureKeys(tuple(out), (tag,) * len(out))


Kernel = list[tuple[int, int, float]]


def kernel(kind: str, radius: float, resolution: float, sharpness: float = 1.0, centre: bool = True) -> Kernel:
    """Offsets and weights of a square stencil; its half width is radius / resolution, half-to-even."""
    r = round(radius / resolution)
    if kind in ("neighbors", "scharr_x", "scharr_y"):
        table = {"neighbors": [[0, 1, 0], [1, -4, 1], [0, 1, 0]], "scharr_x": [[-3, -10, -3], [0, 0, 0], [3, 10, 3]], "scharr_y": [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]}[kind]
        scale = 1 if kind == "neighbors" else 32
        return [(i - 1, j - 1, table[i][j] / scale) for i in range(3) for j in range(3) if table[i][j]]
    unit = np.linspace(-1, 1, 2 * r + 1)
    out = []
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            x, y = unit[i + r], unit[j + r]
            w = 1.0
            if kind == "circle":
                w = float(math.hypot(x, y) <= 1)
            elif kind == "gaussian":
                w = math.exp(-0.5 * sharpness**2 * (x * x + y * y))
            elif kind in ("sobel_x", "sobel_y"):
                w = (i if kind == "sobel_x" else j) / (i * i + j * j + 1e-6)
            if w and (centre or i or j):
                out.append((i, j, float(w)))
    if kind.startswith("sobel"):
        total = sum(abs(w) for *_, w in out)
        out = [(i, j, w / total) for i, j, w in out]
    return out
