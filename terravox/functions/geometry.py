"""Column builders for rigid transforms, spherical coordinates and colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = tuple[Column, ...]


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation of a quaternion, which need not be of unit length; null for one of zeros."""
    size = F.nullif(F.sqrt(x * x + y * y + z * z + w * w), F.lit(0.0))
    x, y, z, w = x / size, y / size, z / size, w / size
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def pose_matrix(p: Cols, q: Cols) -> list[list[Column]]:
    """4 x 4 matrix of a pose: position, quaternion x, y, z, w."""
    return [[*row, t] for row, t in zip(quaternion_matrix(*q), p, strict=True)] + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def transform(xyz: Cols, m) -> Cols:
    """A point by the upper three rows of a 4 x 4 matrix of columns or numbers."""
    return tuple(m[r][0] * xyz[0] + m[r][1] * xyz[1] + m[r][2] * xyz[2] + m[r][3] for r in range(3))


def rigid_inverse(m) -> list[list]:
    """Inverse of a rotation with translation."""
    turned = [[m[c][r] for c in range(3)] for r in range(3)]
    return [[*row, -(row[0] * m[0][3] + row[1] * m[1][3] + row[2] * m[2][3])] for row in turned] + [m[3]]


def compose(a, b) -> list[list]:
    """Product of two 4 x 4 matrices of rigid transforms, of columns or numbers."""
    rows = [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(4)] for r in range(3)]
    return [[*row[:3], row[3] + a[r][3]] for r, row in enumerate(rows)] + [a[3]]


def frame_extrinsics(cloud, image, extrinsics) -> list[list]:
    """A camera's extrinsics set right for the way from a cloud's pose to an image's, both 4 x 4 matrices of columns: per frame and camera."""
    return compose(compose(image, rigid_inverse(cloud)), extrinsics)


def to_spherical(x: Column, y: Column, z: Column) -> dict[str, Column]:
    return {"el": F.atan2(z, F.hypot(x, y)), "az": F.atan2(y, x), "range": F.sqrt(x * x + y * y + z * z)}


def from_spherical(el: Column, az: Column, r: Column) -> dict[str, Column]:
    return {"x": r * F.cos(el) * F.cos(az), "y": r * F.cos(el) * F.sin(az), "z": r * F.sin(el)}


def intrinsics(k, optical: bool = True) -> np.ndarray:
    """4 x 4 from nine numbers or a 3 x 3."""
    if not optical:
        raise ValueError("only optical frames are supported")
    out = np.eye(4)
    out[:3, :3] = np.asarray(k, float).reshape(3, 3)
    return out


def projection(k: np.ndarray, extrinsics: np.ndarray) -> np.ndarray:
    return (k @ extrinsics)[:3]


def rescaled(k: dict[str, Column], width: float, height: float, new_width: float, new_height: float) -> dict[str, Column]:
    """Intrinsics after an image has been resized."""
    return {"fx": k["fx"] * (new_width / width), "cx": k["cx"] * (new_width / width), "fy": k["fy"] * (new_height / height), "cy": k["cy"] * (new_height / height)}


def corrected_extrinsics(image_pose: np.ndarray, cloud_pose: np.ndarray, extrinsics: np.ndarray) -> np.ndarray:
    """Extrinsics after the vehicle has moved between cloud and image."""
    return image_pose @ np.linalg.inv(cloud_pose) @ extrinsics


def unpack_rgb(packed: Column) -> dict[str, Column]:
    """Channels in [0, 1] of 0xRRGGBB."""
    return {c: F.shiftright(packed, s).bitwiseAND(F.lit(255)) / 255.0 for c, s in (("r", 16), ("g", 8), ("b", 0))}


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """0xRRGGBB of channels in [0, 1]."""
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")
    return F.shiftleft(byte(r), 16) + F.shiftleft(byte(g), 8) + byte(b)


def fibonacci_palette(n: int) -> list[list[float]]:
    """n colours in [0, 1], evenly over a sphere."""
    k = np.arange(n)
    polar, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    return (np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], 1) / 2 + 0.5).tolist()


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length, null where one is null."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector at length 1; one of zeros stays as it is. Its length is worked out once, not for each entry."""
    return F.get(F.transform(F.array(norm(a)), lambda size: F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))), F.lit(0))


def apply_palette(v: Column, palette: list[list[float]], soft: bool = False) -> dict[str, Column]:
    """Colour of a vector: its entries weigh the palette's colours."""
    v = softmax(v) if soft else v
    return {c: dot(v, F.array(*(F.lit(p[k]) for p in palette))) for k, c in enumerate("rgb")}
