"""Cameras, pixels, and lists of image coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(points: DataFrame, cameras: list[dict]) -> DataFrame:
    """Each point in each camera that sees it: cam, u, v, depth.

    The cameras of a rig are a bounded list, so they enter the plan as a constant array.
    """
    rows = F.array(*(F.struct(F.lit(c["cam"]).alias("cam"), F.lit(c["width"]).alias("width"), F.lit(c["height"]).alias("height"), F.array(*(F.lit(float(v)) for row in c["p"] for v in row)).alias("p")) for c in cameras))
    seen = points.withColumn("_c", F.explode(rows))
    line = lambda r: F.col("_c.p")[4 * r] * F.col("x") + F.col("_c.p")[4 * r + 1] * F.col("y") + F.col("_c.p")[4 * r + 2] * F.col("z") + F.col("_c.p")[4 * r + 3]
    seen = seen.withColumns({"_u": line(0), "_v": line(1), "depth": line(2)}).where("depth > 0")
    seen = seen.withColumns({"cam": F.col("_c.cam"), "u": F.col("_u") / F.col("depth"), "v": F.col("_v") / F.col("depth")})
    return seen.where((F.col("u") >= 0) & (F.col("u") < F.col("_c.width")) & (F.col("v") >= 0) & (F.col("v") < F.col("_c.height"))).drop("_c", "_u", "_v")


def unoccluded(seen: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """Points no farther than the nearest of their pixel + cutoff. The nearest comes from an aggregation that combines before the shuffle."""
    at = seen.withColumns({"pu": F.floor("u").cast("long"), "pv": F.floor("v").cast("long")})
    near = at.groupBy("cam", "pu", "pv").agg(F.min("depth").alias("_near"))
    return at.join(near, ["cam", "pu", "pv"]).where(F.col("depth") <= F.col("_near") + cutoff).drop("_near")


def bilinear(coords: DataFrame, pixels: DataFrame, key: list[str], image: str, width: int, height: int, value: str = "value") -> DataFrame:
    """Interpolated value at (u, v) of each key's image; neighbours beyond the edge are the edge."""
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in (0, 1) for b in (0, 1))))
    at = coords.withColumn("_k", corner)
    u0, v0 = F.floor("u"), F.floor("v")
    weight = F.when(F.col("_k.du") == 1, F.col("u") - u0).otherwise(1 - (F.col("u") - u0)) * F.when(F.col("_k.dv") == 1, F.col("v") - v0).otherwise(1 - (F.col("v") - v0))
    held = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    at = at.withColumns({"_w": weight, "pu": held(u0 + F.col("_k.du"), width), "pv": held(v0 + F.col("_k.dv"), height)})
    return at.join(pixels, [image, "pu", "pv"]).groupBy(*key).agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def resize(image: DataFrame, key: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Images (key, u, v, value) at another size, as rows (key, ou, ov, value).

    Weights and source pixels depend on the sizes alone: a source pixel is spread over its targets, one shuffle in all.
    """
    def shares(n: int, m: int) -> list[list[tuple[int, float]]]:
        out = [dict() for _ in range(n)]
        for o in range(m):
            at = (o + 0.5) * n / m - 0.5
            low = math.floor(at)
            for source, w in ((low, 1 - (at - low)), (low + 1, at - low)):
                held = max(0, min(n - 1, source))
                out[held][o] = out[held].get(o, 0.0) + w
        return [sorted(x.items()) for x in out]

    taps = lambda n, m: F.array(*(F.array(*(F.struct(F.lit(o).cast("long").alias("o"), F.lit(w).alias("w")) for o, w in s)) for s in shares(n, m)))
    wide = image.withColumn("_u", F.explode(taps(size[0], to[0])[F.col("u").cast("int")])).withColumn("_v", F.explode(taps(size[1], to[1])[F.col("v").cast("int")]))
    return wide.groupBy(*key, F.col("_u.o").alias("ou"), F.col("_v.o").alias("ov")).agg(F.sum(F.col("_u.w") * F.col("_v.w") * F.col("value")).alias("value"))


def colorize(points: DataFrame, sampled: DataFrame, key: list[str], value: str = "value", eps: float = 1e-6) -> DataFrame:
    """Mean over the cameras that see a point, and their number; unseen points are 0."""
    mean = sampled.groupBy(*key).agg((F.sum(value) / (F.count(F.lit(1)) + eps)).alias(value), F.count(F.lit(1)).alias("n_cams"))
    return points.join(mean, key, "left").na.fill(0, [value, "n_cams"])


def top_coords(entries: DataFrame, key: list[str], k: int) -> DataFrame:
    """Each key's k heaviest (seq, cam, u, v, w), ties by the other fields, weights made to sum to 1.

    Only k rows a key leave the ranking, whatever its size.
    """
    order = Window.partitionBy(*key).orderBy(F.col("w").desc(), "seq", "cam", "u", "v")
    best = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    listed = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", "seq", "cam", "u", "v", "w"))).alias("c"), F.sum("w").alias("_s"))
    total = F.greatest(F.col("_s"), F.lit(1e-8))
    return listed.select(*key, F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in ("seq", "cam", "u", "v")), (x["w"] / total).alias("w"))).alias("coords"))


def merge_coords(old: DataFrame, new: DataFrame, key: list[str], k: int, alpha: float, most: float | None = None) -> DataFrame:
    """Lists of both sides, weighted 1 - alpha and alpha where both have one, cut to the k heaviest; weights are divided by their sum, of at most `most` (maps: 1)."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1))).groupBy(*key).agg(*(F.max(F.when(F.col("_n") == s, F.col("coords"))).alias(f"_{s}") for s in (0, 1)))
    scaled = lambda c, w: F.transform(c, lambda x: F.struct((-x["w"] * w).alias("m"), *(x[f].alias(f) for f in ("seq", "cam", "u", "v"))))
    blended = F.coalesce(F.concat(scaled(F.col("_0"), 1 - alpha), scaled(F.col("_1"), alpha)), scaled(F.col("_1"), 1.0), scaled(F.col("_0"), 1.0))
    cut = both.select(*key, F.slice(F.array_sort(blended), 1, k).alias("c"))
    total = F.greatest(F.aggregate("c", F.lit(0.0), lambda s, x: s - x["m"]), F.lit(1e-8))
    total = total if most is None else F.least(total, F.lit(most))
    return cut.select(*key, F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in ("seq", "cam", "u", "v")), (-x["m"] / total).alias("w"))).alias("coords"))


def recolor(coords: DataFrame, pixels: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Sum of weight * pixel over a key's coordinates."""
    at = coords.select(*key, F.explode("coords").alias("c")).select(*key, "c.*")
    at = at.withColumns({"pu": F.floor("u").cast("long"), "pv": F.floor("v").cast("long")})
    return at.join(pixels, ["cam", "pu", "pv"]).groupBy(*key).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def contributions(coords: DataFrame) -> DataFrame:
    """Share of all weight that each image has, and the running share from the largest on."""
    each = coords.select(F.explode("coords").alias("c")).groupBy("c.seq", "c.cam").agg(F.sum("c.w").alias("w"))
    # One row per image: small enough for one ordered window.
    whole = Window.orderBy(F.col("share").desc(), "seq", "cam").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).withColumn("cumulative", F.sum("share").over(whole)).drop("w")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] by their bounds over the whole table; constant ones become 0. The bounds are one row."""
    low = df.agg(*(F.min(c).alias(f"_l{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"_h{i}") for i, c in enumerate(columns))).first()
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    return df.withColumns({c: F.coalesce((F.col(c) - lit(low[f"_l{i}"])) / F.nullif(lit(low[f"_h{i}"]) - lit(low[f"_l{i}"]), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)})


def palette_mask(r: Column, g: Column, b: Column, bright: float = 253) -> Column:
    return (r + g + b) / 3 > bright


def coords_of(flat: Column, k: int) -> Column:
    """Array of k structs (seq, cam, u, v, w) from the flat layout: all seq, then all cam, u, v and w."""
    part = lambda n: F.slice(flat, n * k + 1, k)
    names = ("seq", "cam", "u", "v", "w")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(*(F.get(part(n), i).alias(c) for n, c in enumerate(names))))
