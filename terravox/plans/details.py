"""Queries over sensors with beams of their own, turned sensors, frames around frames, masks, messages and map cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry
from ..grid import KEYS
from ..operators import columns, pixels, rays, temporal, vectors, voxel
from ..sources import files, tables
from ..sources.tables import META, SENSOR, round6
from .registry import _D, _inside, _voxels, query, r6, rounded

_BEAMS = rays.SensorModel.named("vlp32c")
_EDGES = "[" + ", ".join(repr(math.radians(e)) for e in _BEAMS.el_edges) + "]::DOUBLE[]"
_STEP = (math.radians(180.0) - math.radians(-180.0)) / 900
_EL, _AZ = "atan2(z - 5.0, sqrt((x - 25.0) * (x - 25.0) + (y - 20.0) * (y - 20.0)))", "atan2(y - 20.0, x - 25.0)"


@query(
    f"+a AS (SELECT {_EL} AS el, {_AZ} AS az, sqrt({_D}) AS r FROM ins), b AS (SELECT *, len(list_filter({_EDGES}, lambda e: e < el)) - 1 AS up, CAST(ceil((az - {math.radians(-180.0)!r}) / {_STEP!r}) - 1 AS BIGINT) AS turn FROM a) "
    f"SELECT CAST(up * 900 + turn AS BIGINT) AS bin, {r6('max(r)')} AS bin_range FROM b WHERE up >= 0 AND up < 32 AND el - ({_EDGES})[up + 1] <= {math.radians(rays.BEAM_HEIGHT)!r} + 1e-9 AND turn >= 0 AND turn < 900 GROUP BY 1",
    "pts ins",
)
def beam_ranges(spark, d):
    """Farthest return of each bin of a sensor whose beams lie at elevations of their own."""
    return rounded(rays.bin_ranges(_inside(spark, d), _BEAMS, SENSOR), "bin_range")


@query(f"SELECT gx, gy, gz, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM vox", "pts ins vox")
def turned_round_trip(spark, d):
    """Voxels as a turned sensor sees them, and back."""
    sensor = (1.0, 2.0, 3.0, 0.1, -0.3, 0.5, 0.8)
    at = rays.local(_voxels(spark, d).select(*KEYS).withColumns(META.centres()), sensor, F.col("cx"), F.col("cy"), F.col("cz"))
    back = rays.placed(at, sensor, F.col("el"), F.col("az"), F.col("range"))
    return rounded(back.select(*KEYS, "x", "y", "z"), "x", "y", "z")


@query(f"+f AS (SELECT run, p, row_number() OVER (PARTITION BY run ORDER BY t) AS idx FROM odo) SELECT a.run, a.idx, count(*) AS n, {r6('avg(b.p)')} AS p FROM f a JOIN f b ON a.run = b.run AND b.idx >= a.idx - 50 AND b.idx < a.idx + 50 AND (b.idx - a.idx + 50) % 5 = 0 GROUP BY a.run, a.idx", "odo")
def accumulated_frames(spark, d):
    """Every fifth frame from fifty before to fifty after each: how many there are, and their mean place."""
    frames = temporal.numbered(tables.odometry(spark, d), "run", "idx").select("run", "idx", "p")
    near = temporal.frames_around(frames, "run", 50, 50, 5, ["p"])
    return rounded(near.groupBy("run", "idx").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")), "p")


_MASKS = {"bright": "x > 0.05", "upper": "d < 32", "dark": "x < -0.1"}


@query(f"+e AS (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_), m AS ({' UNION ALL '.join(f'SELECT vec_id, d, x, {name!r} AS mask FROM e WHERE {c}' for name, c in _MASKS.items())}) SELECT mask, count(*) AS n, {r6('avg(x)')} AS x FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, d) AS k FROM m) WHERE k = 1 GROUP BY mask", "desc_")
def mask_prototypes(spark, d):
    """Mean value of the pixels that lie in one mask alone."""
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode("v").alias("d", "x"))
    masks = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in _MASKS.items())))
    return rounded(vectors.means_only(each.withColumn("mask", F.explode(masks)), ["vec_id", "d"], "mask", ["x"]), "x")


@query(f"SELECT vec_id, i AS k, {', '.join(f'{r6(f'CAST(v[{12 * n} + i + 1] AS DOUBLE)')} AS {c}' for n, c in enumerate(('seq', 'cam', 'u', 'v_', 'w')))} FROM desc_, (SELECT unnest(range(12)) AS i)", "desc_")
def flat_coordinates(spark, d):
    """Lists of twelve coordinates from the flat layout that a voxel's features hold."""
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode(pixels.coords_of(F.col("v"), 12)).alias("k", "c"))
    return each.select("vec_id", F.col("k").cast("long").alias("k"), *(round6(F.col(f"c.{c}")).alias("v_" if c == "v" else c) for c in ("seq", "cam", "u", "v", "w")))


@query(
    f"+c AS (SELECT scan_id, gx, gy, avg(f0) AS f, count(*) AS n FROM ins WHERE f0 IS NOT NULL GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY scan_id DESC) AS back, count(*) OVER (PARTITION BY gx, gy) AS k FROM c) SELECT gx, gy, {r6('sum(f * CASE WHEN back = k THEN power(0.7, k - 1) ELSE 0.3 * power(0.7, back - 1) END)')} AS f0, CAST(sum(n) AS BIGINT) AS hits FROM rk GROUP BY gx, gy",
    "pts ins",
)
def bev_feature_merge(spark, d):
    """Features of map cells over all scans, as a moving average."""
    grids = columns.bev_from_points(_inside(spark, d), META, ["f0"], per=("scan_id",))
    return rounded(columns.fold_features(grids, ["f0"], 0.3, "scan_id").withColumn("hits", F.col("hits").cast("long")), "f0")


@query(f"SELECT gx, gy, gz, {r6('f0 + f1')} AS total, {r6('f0 * 2')} AS doubled FROM vox", "pts ins vox")
def replaced_features(spark, d):
    made = voxel.replace_features(_voxels(spark, d).select(*KEYS, "f0", "f1"), ["f0", "f1"], {"total": F.col("f0") + F.col("f1"), "doubled": F.col("f0") * 2})
    return rounded(made, "total", "doubled")


@query("SELECT gx, gy, gx * 40 + gy AS raster, count(*) AS n, true AS same FROM ins GROUP BY gx, gy", "pts ins")
def map_raster(spark, d):
    """Row-major numbers of map cells, and back."""
    flat = META.dims(0, 1)
    at = _inside(spark, d).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n")).withColumn("raster", flat.raster())
    back = flat.from_raster(F.col("raster"))
    return at.select("gx", "gy", "raster", "n", ((back["gx"] == F.col("gx")) & (back["gy"] == F.col("gy"))).alias("same"))


@query(f"SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE NOT inside) AS outside, {r6('sum(px)')} AS px, {r6('sum(py)')} AS py, {r6('sum(pz)')} AS pz FROM (SELECT scan_id, x / 1.0 AS px, y / 1.0 AS py, z / 0.5 AS pz, x >= 0 AND x < 50 AND y >= 0 AND y < 40 AND z >= 0 AND z < 21 AS inside FROM pts) GROUP BY scan_id", "pts")
def grid_positions(spark, d):
    """Unrounded places on the grid, and how many points lie outside."""
    at = tables.points(spark, d).select("scan_id", *(c.alias(n) for n, c in META.position().items()), META.contains_points().alias("inside"))
    sums = [F.sum(c).alias(c) for c in ("px", "py", "pz")]
    return rounded(at.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("inside"), 1)).alias("outside"), *sums), "px", "py", "pz")


@query(f"SELECT gx, gy, gz, k.name AS feature, {r6('CASE k.name WHEN $$f0$$ THEN f0 ELSE f1 END')} AS value, CAST(hits AS BIGINT) AS hits, misses, 21.0::DOUBLE AS height, 0.5::DOUBLE AS cell FROM vox, (SELECT unnest(['f0', 'f1']) AS name) k", "pts ins vox")
def voxel_messages(spark, d):
    """What a voxel message holds, one row a voxel and feature."""
    message = files.voxel_message(_voxels(spark, d), ["f0", "f1"], META)
    each = message.select(*KEYS, F.explode(F.arrays_zip(F.split("feature_keys", ",").alias("feature"), F.col("features").alias("value"))).alias("e"), "hits", "misses", F.col("length")[2].alias("height"), F.col("resolution")[2].alias("cell"))
    return each.select(*KEYS, "e.feature", round6(F.col("e.value")).alias("value"), "hits", "misses", "height", "cell")


@query("SELECT scan_id, count(*) AS n FROM (SELECT scan_id, floor((x + 0.5) / 10) AS a, floor(y / 8) AS b, CASE WHEN f0 IS NOT NULL THEN floor(z / 4) END AS c FROM pts) WHERE c IS NOT NULL AND a * a + b * b + c * c > 0 GROUP BY scan_id", "pts")
def valid_points(spark, d):
    """Points that are not at the origin and have no NaN."""
    nan = F.lit(float("nan"))
    at = tables.points(spark, d).select("scan_id", F.floor((F.col("x") + 0.5) / 10).cast("double").alias("x"), F.floor(F.col("y") / 8).cast("double").alias("y"), F.when(F.col("f0").isNotNull(), F.floor(F.col("z") / 4).cast("double")).otherwise(nan).alias("z"))
    return files.valid_points(at).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, {r6('(400.0 + vec_id) * 1.5')} AS fx, {r6('(300.0 + vec_id % 7) * 1.5')} AS cx, {r6('(400.0 + vec_id) * 0.75')} AS fy, {r6('(200.0 + vec_id % 5) * 0.75')} AS cy FROM embeddings")
def rescaled_intrinsics(spark, d):
    """Intrinsics of images that are brought from 640 x 480 to 960 x 360."""
    k = {"fx": 400.0 + F.col("vec_id"), "cx": 300.0 + F.col("vec_id") % 7, "fy": 400.0 + F.col("vec_id"), "cy": 200.0 + F.col("vec_id") % 5}
    return tables.table(spark, d, "embeddings").select("vec_id", *(round6(c).alias(n) for n, c in geometry.rescaled(k, 640, 480, 960, 360).items()))
