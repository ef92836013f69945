"""Queries that bind the operators to the test tables, each with the SQL of the same result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..grid import KEYS, GridMeta, kernel
from ..operators import columns, covariance, pixels, rays, stencil, temporal, vectors, voxel
from ..sources import tables
from ..sources.tables import META, SENSOR, round6
from . import terrain

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Steps of the SQL side by name; a query names those it needs, in order.
STEPS = {
    "pts": "SELECT CAST(year(l_shipdate) - 1995 AS BIGINT) AS scan_id, l_quantity - 0.5 AS x, (l_partkey % 40) + 0.5 AS y, l_extendedprice / 10000.0 AS z, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS f0, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS f1 FROM lineitem",
    "ins": "SELECT *, CAST(floor(x) AS BIGINT) AS gx, CAST(floor(y) AS BIGINT) AS gy, CAST(floor(z / 0.5) AS BIGINT) AS gz FROM pts WHERE x >= 0 AND x < 50 AND y >= 0 AND y < 40 AND z >= 0 AND z < 21",
    "vox": "SELECT gx, gy, gz, avg(f0) AS f0, avg(f1) AS f1, count(*) AS n, min(z) AS min_z, max(z) AS max_z, count(DISTINCT scan_id) AS hits, CAST((gx + 2 * gy + 3 * gz) % 7 AS DOUBLE) AS misses, gx + 0.5 AS x, gy + 0.5 AS y, gz * 0.5 + 0.25 AS z FROM ins GROUP BY gx, gy, gz",
    "cells": "SELECT i, j, avg(z) AS z, max(z) AS top, count(*) AS n FROM (SELECT o_custkey % 40 AS i, dayofyear(o_orderdate) % 40 AS j, o_totalprice / 100000.0 AS z FROM orders) GROUP BY i, j",
    "bev": "SELECT i, j, z, top, CAST(n >= 8 AS DOUBLE) AS m FROM cells",
    "odo": "SELECT event_id, user_id AS run, epoch_us(ts) AS t, value AS p, event_type FROM events",
    "desc_": "SELECT vec_id, label, embedding AS v FROM embeddings",
    "means": "SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_) GROUP BY label, d",
    "terr": "SELECT gx, gy, min_z AS terrain FROM (SELECT gx, gy, min(z) AS min_z FROM ins GROUP BY gx, gy)",
}


def query(sql: str | None = None, steps: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            named = ", ".join(f"{s} AS ({STEPS[s]})" for s in steps.split())
            ORACLE_SQL[f.__name__] = f"WITH {named}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if named else sql
        return f

    return add


def r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round6(n) for n in names})


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return voxel.keyed(tables.points(spark, d), META)


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    made = _inside(spark, d).groupBy(*KEYS).agg(F.avg("f0").alias("f0"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.countDistinct("scan_id").alias("hits"))
    return made.withColumn("misses", ((F.col("gx") + 2 * F.col("gy") + 3 * F.col("gz")) % 7).cast("double"))


def _bev(spark: SparkSession, d: str) -> DataFrame:
    return tables.cells(spark, d).select("i", "j", "z", "top", (F.col("n") >= 8).cast("double").alias("m"))




# Voxels


@query(f"SELECT gx, gy, gz, (gx * 40 + gy) * 42 + gz AS raster, {r6('gx + 0.5')} AS cx, {r6('gz * 0.5 + 0.25')} AS cz, count(*) AS n FROM ins GROUP BY gx, gy, gz", "pts ins")
def voxel_keys(spark, d):
    at = _inside(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).withColumns({"raster": META.raster(), **META.centres()})
    return rounded(at.select(*KEYS, "raster", "cx", "cz", "n"), "cx", "cz")


@query("SELECT r AS raster, r // 1680 AS gx, (r // 42) % 40 AS gy, r % 42 AS gz FROM (SELECT DISTINCT (gx * 40 + gy) * 42 + gz AS r FROM ins)", "pts ins")
def raster_round_trip(spark, d):
    return _inside(spark, d).select(META.raster().alias("raster")).distinct().withColumns(META.from_raster(F.col("raster"))).select("raster", *KEYS)


@query(f"SELECT gx, gy, gz, {r6('avg(f0)')} AS f0, {r6('avg(f1)')} AS f1 FROM ins WHERE f0 IS NOT NULL GROUP BY gx, gy, gz", "pts ins")
def voxelize_avg(spark, d):
    return rounded(voxel.mean_features(_inside(spark, d), ["f0", "f1"]), "f0", "f1")


_D = "(x - 25.0) * (x - 25.0) + (y - 20.0) * (y - 20.0) + (z - 5.0) * (z - 5.0)"
_NEAR = f"near AS (SELECT *, {_D} AS dist, min({_D}) OVER (PARTITION BY scan_id, gx, gy, gz) AS low FROM ins WHERE f0 IS NOT NULL)"


@query(f"+near AS (SELECT *, {_D} AS dist, min({_D}) OVER (PARTITION BY gx, gy, gz) AS low FROM ins WHERE f0 IS NOT NULL) SELECT gx, gy, gz, {r6('avg(f0)')} AS f0, {r6('avg(f1)')} AS f1 FROM near WHERE dist = low GROUP BY gx, gy, gz", "pts ins")
def voxelize_mindist(spark, d):
    return rounded(voxel.nearest_features(_inside(spark, d), ["f0", "f1"], SENSOR), "f0", "f1")


@query(f"SELECT gx, gy, gz, 1.0 AS hits, 0.0 AS misses, {r6('min(x)')} AS min_x, {r6('max(x)')} AS max_x, {r6('min(z)')} AS min_z, {r6('max(z)')} AS max_z, CAST(min(scan_id) AS DOUBLE) AS first_update, CAST(max(scan_id) AS DOUBLE) AS last_update, {r6('avg(f0)')} AS f0 FROM ins GROUP BY gx, gy, gz", "pts ins")
def voxel_hits_bounds(spark, d):
    made = voxel.voxelize(tables.points(spark, d), META, ["f0"], F.col("scan_id").cast("double"), "avg")
    return rounded(made.select(*KEYS, "hits", "misses", "min_x", "max_x", "min_z", "max_z", "first_update", "last_update", "f0"), "min_x", "max_x", "min_z", "max_z", "f0")


@query(
    f"+per AS (SELECT scan_id, gx, gy, gz, min(z) AS lo, max(z) AS hi, avg(f0) AS f FROM ins GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY scan_id DESC) AS back, count(*) OVER (PARTITION BY gx, gy, gz) AS n FROM per WHERE f IS NOT NULL), ema AS (SELECT gx, gy, gz, sum(f * CASE WHEN back = n THEN power(0.5, n - 1) ELSE power(0.5, back) END) AS f FROM rk GROUP BY gx, gy, gz), b AS (SELECT gx, gy, gz, CAST(count(*) AS DOUBLE) AS hits, min(lo) AS lo, max(hi) AS hi, min(scan_id) AS one, max(scan_id) AS two FROM per GROUP BY gx, gy, gz) SELECT gx, gy, gz, hits, {r6('lo')} AS min_z, {r6('hi')} AS max_z, CAST(one AS DOUBLE) AS first_update, CAST(two AS DOUBLE) AS last_update, {r6('f')} AS f0 FROM b LEFT JOIN ema USING (gx, gy, gz)",
    "pts ins",
)
def voxel_merge(spark, d):
    scans = voxel.voxelize(tables.points(spark, d), META, ["f0"], F.col("scan_id").cast("double"), "avg", per=("scan_id",))
    return rounded(voxel.merge_all(scans, ["f0"], 0.5, "scan_id").select(*KEYS, "hits", "min_z", "max_z", "first_update", "last_update", "f0"), "min_z", "max_z", "f0")


@query(
    f"+{_NEAR}, per AS (SELECT scan_id, gx, gy, gz, avg(f0) AS f, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY scan_id DESC) AS back, count(*) OVER (PARTITION BY gx, gy, gz) AS n FROM near WHERE dist = low GROUP BY scan_id, gx, gy, gz) SELECT gx, gy, gz, CAST(max(n) AS BIGINT) AS n_scans, {r6('sum(f * CASE WHEN back = n THEN power(0.5, n - 1) ELSE power(0.5, back) END)')} AS f0 FROM per GROUP BY gx, gy, gz",
    "pts ins",
)
def voxel_merge_ema(spark, d):
    inside = _inside(spark, d)
    distance = (F.col("x") - SENSOR[0]) ** 2 + (F.col("y") - SENSOR[1]) ** 2 + (F.col("z") - SENSOR[2]) ** 2
    at = inside.where("f0 is not null").withColumn("_d", distance).groupBy("scan_id", *KEYS, "_d").agg(F.avg("f0").alias("f0"))
    per_scan = at.groupBy("scan_id", *KEYS).agg(F.min_by("f0", "_d").alias("f0"))
    return rounded(voxel.fold(per_scan, ["f0"], 0.5, "scan_id"), "f0")


@query("SELECT gx, gy, gz, CAST(hits AS BIGINT) AS hits, misses FROM (SELECT *, min(gz) OVER (PARTITION BY gx, gy) AS low FROM vox) WHERE misses / (hits + misses) <= 0.75 OR gz = low", "pts ins vox")
def voxel_cull(spark, d):
    return voxel.cull(_voxels(spark, d)).select(*KEYS, "hits", "misses")


@query("SELECT gx - 10 AS gx, gy - 5 AS gy, gz - 4 AS gz, CAST(n AS BIGINT) AS n FROM vox WHERE gx - 10 BETWEEN 0 AND 24 AND gy - 5 BETWEEN 0 AND 19 AND gz - 4 BETWEEN 0 AND 15", "pts ins vox")
def voxel_shift_crop(spark, d):
    return voxel.crop(_voxels(spark, d), META, GridMeta((10.0, 5.0, 2.0), (25.0, 20.0, 8.0), META.resolution)).select(*KEYS, "n")


@query(f"SELECT gx, gy, gz, {r6('(min_z + max_z) / 2')} AS mid_z, f0 IS NOT NULL AS has_features FROM vox", "pts ins vox")
def voxel_midpoints(spark, d):
    return rounded(_voxels(spark, d).select(*KEYS, ((F.col("min_z") + F.col("max_z")) / 2).alias("mid_z"), F.col("f0").isNotNull().alias("has_features")), "mid_z")


_TURN = "+k AS (SELECT DISTINCT scan_id, gx, gy, gz FROM ins), p AS (SELECT DISTINCT scan_id FROM k WHERE scan_id + 1 IN (SELECT scan_id FROM k)), a AS (SELECT * FROM k WHERE scan_id IN (SELECT scan_id FROM p)), b AS (SELECT scan_id - 1 AS scan_id, gx, gy, gz FROM k WHERE scan_id - 1 IN (SELECT scan_id FROM p))"


@query(f"{_TURN} SELECT scan_id, count(*) FILTER (WHERE x.k AND y.k) AS both, count(*) FILTER (WHERE y.k IS NULL) AS only_a, count(*) FILTER (WHERE x.k IS NULL) AS only_b FROM (SELECT *, true AS k FROM a) x FULL JOIN (SELECT *, true AS k FROM b) y USING (scan_id, gx, gy, gz) GROUP BY scan_id", "pts ins")
def grid_overlap(spark, d):
    """Voxels that each scan shares with the next."""
    return voxel.overlaps_in_turn(_inside(spark, d), "scan_id")


@query(f"{_TURN} SELECT *, 1 AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 2 AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", "pts ins")
def symmetric_difference(spark, d):
    return voxel.sides_in_turn(_inside(spark, d), "scan_id").where("side <> 3")


@query("SELECT DISTINCT gx, gy, gz FROM ins WHERE f0 IS NULL EXCEPT SELECT gx, gy, gz FROM ins WHERE f0 IS NOT NULL", "pts ins")
def voxels_without_features(spark, d):
    inside = _inside(spark, d)
    return inside.where("f0 is null").select(*KEYS).distinct().join(inside.where("f0 is not null").select(*KEYS), list(KEYS), "left_anti")


@query(
    "SELECT count(*) AS voxels, CAST(sum(hits) AS DOUBLE) AS hits, count(*) FILTER (WHERE gx < 0 OR gx > 49 OR gy < 0 OR gy > 39 OR gz < 0 OR gz > 41 OR lo > hi OR one > two OR hits < 1) AS broken FROM (SELECT gx, gy, gz, count(DISTINCT scan_id) AS hits, min(z) AS lo, max(z) AS hi, min(scan_id) AS one, max(scan_id) AS two FROM ins GROUP BY gx, gy, gz)",
    "pts ins",
)
def voxel_invariants(spark, d):
    """Voxels, evidence and broken rows of the map that all scans make."""
    scans = voxel.voxelize(tables.points(spark, d), META, ["f0"], F.col("scan_id").cast("double"), "avg", per=("scan_id",))
    made = voxel.merge_all(scans, ["f0"], 0.5, "scan_id")
    bad = voxel.broken(made, META).agg(F.count(F.lit(1)).alias("broken"))
    return made.agg(F.count(F.lit(1)).alias("voxels"), F.sum("hits").alias("hits")).crossJoin(bad)


# Rays

MODEL = rays.SensorModel((-60.0, 60.0, 24), (-180.0, 180.0, 72))


def _bin_sql(x: str, y: str, z: str) -> str:
    def place(c, spec):
        low, step = math.radians(spec[0]), (math.radians(spec[1]) - math.radians(spec[0])) / spec[2]
        at = f"CAST(ceil(({c} - {low!r}) / {step!r}) - 1 AS BIGINT)"
        return f"CASE WHEN {at} >= 0 AND {at} < {spec[2]} THEN {at} END"

    return f"({place(f'atan2({z}, sqrt(({x}) * ({x}) + ({y}) * ({y})))', MODEL.el)}) * 72 + ({place(f'atan2({y}, {x})', MODEL.az)})"


_SEEN = f"seen AS (SELECT {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM ins), bins AS (SELECT bin, max(r) AS far FROM seen WHERE bin IS NOT NULL GROUP BY bin)"


@query(f"+{_SEEN} SELECT bin, {r6('far')} AS bin_range FROM bins", "pts ins")
def ray_bins(spark, d):
    return rounded(rays.bin_ranges(_inside(spark, d), MODEL, SENSOR), "bin_range")


@query(f"+{_SEEN}, vat AS (SELECT *, {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM vox) SELECT gx, gy, gz, misses + CASE WHEN vat.bin IS NOT NULL AND r < coalesce(far, 200.0) THEN 1.0 ELSE 0.0 END AS misses FROM vat LEFT JOIN bins ON vat.bin = bins.bin AND bins.bin > 0", "pts ins vox")
def raytrace(spark, d):
    return rays.raytrace(_voxels(spark, d), _inside(spark, d), MODEL, SENSOR, META.centres()).select(*KEYS, "misses")


@query(f"SELECT gx, gy, gz, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM vox", "pts ins vox")
def spherical_round_trip(spark, d):
    at = rays.local(_voxels(spark, d).withColumns(META.centres()), (1.0, 2.0, 3.0), F.col("cx"), F.col("cy"), F.col("cz"))
    back = geometry.from_spherical(F.col("el"), F.col("az"), F.col("range"))
    return at.select(*KEYS, *(round6(back[a] + s).alias(a) for a, s in zip("xyz", (1.0, 2.0, 3.0), strict=True)))


@query(f"+{_SEEN}, vat AS (SELECT f0, {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM vox WHERE f0 IS NOT NULL), low AS (SELECT bin, min(round(r, 6)) AS q FROM vat WHERE bin IS NOT NULL GROUP BY bin) SELECT bin, {r6('min(r)')} AS depth, {r6('avg(f0)')} AS f0 FROM vat JOIN low USING (bin) WHERE round(r, 6) = q GROUP BY bin", "pts ins vox")
def render_depth(spark, d):
    return rounded(rays.render(_voxels(spark, d).where("f0 is not null"), MODEL, SENSOR, META.centres(), ["f0"]), "depth", "f0")


# Columns and maps


@query(f"SELECT gx, gy, {r6('min(z)')} AS min_elevation, {r6('avg(z)')} AS mean_elevation, {r6('max(z)')} AS max_elevation, count(*) AS num_voxels FROM vox GROUP BY gx, gy", "pts ins vox")
def elevation_stats(spark, d):
    return rounded(columns.elevation_stats(_voxels(spark, d), META.centres()["cz"]), "min_elevation", "mean_elevation", "max_elevation")


@query(f"SELECT gx, gy, {r6('avg(misses / (hits + misses))')} AS porosity FROM vox GROUP BY gx, gy", "pts ins vox")
def porosity(spark, d):
    return rounded(columns.porosity(_voxels(spark, d)), "porosity")


@query(f"SELECT gx, gy, {r6('avg(f0)')} AS f0, {r6('avg(f1)')} AS f1 FROM vox WHERE f0 IS NOT NULL GROUP BY gx, gy", "pts ins vox")
def bev_feature_splat(spark, d):
    return rounded(columns.feature_splat(_voxels(spark, d), ["f0", "f1"]), "f0", "f1")


def _terrain(spark, d):
    return _inside(spark, d).groupBy("gx", "gy").agg(F.min("z").alias("terrain"))


@query(f"SELECT gx, gy, {r6('max(f0)')} AS f0 FROM vox JOIN terr USING (gx, gy) WHERE z < terrain + 2.0 AND f0 IS NOT NULL GROUP BY gx, gy", "pts ins vox terr")
def terrain_aware_splat(spark, d):
    return rounded(columns.terrain_splat(_voxels(spark, d), _terrain(spark, d), META.centres()["cz"], ["f0"], 2.0, "max"), "f0")


@query(f"SELECT gx, gy, {r6('greatest(0.0, least(2.0, coalesce(max(z - terrain) FILTER (WHERE z - terrain < 2.0), 0.0)))')} AS diff FROM terr LEFT JOIN vox USING (gx, gy) GROUP BY gx, gy", "pts ins vox terr")
def terrain_diff(spark, d):
    return rounded(columns.terrain_diff(_voxels(spark, d), _terrain(spark, d), META.centres()["cz"], 2.0), "diff")


@query(f"SELECT gx, gy, {r6('avg(f0)')} AS f0, count(*) AS hits FROM ins WHERE f0 IS NOT NULL GROUP BY gx, gy", "pts ins")
def bev_from_points(spark, d):
    return rounded(columns.bev_from_points(_inside(spark, d).drop(*KEYS), META, ["f0"]), "f0")


_ELEV = "(SELECT gx, gy, min(z) AS lo, max(z) AS hi, count(*) AS n FROM ins GROUP BY gx, gy)"


@query(f"SELECT gx, gy, {r6('min(z)')} AS min_elevation, {r6('max(z)')} AS max_elevation, count(*) AS hits FROM ins GROUP BY gx, gy", "pts ins")
def elevation_grid(spark, d):
    return rounded(columns.elevation_grid(_inside(spark, d).drop(*KEYS), META), "min_elevation", "max_elevation")


@query(
    f"+lows AS (SELECT scan_id, gx, gy, min(z) AS lo FROM ins GROUP BY ALL), mem AS (SELECT *, min(lo) OVER (PARTITION BY gx, gy ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM lows) SELECT scan_id, gx, gy, count(*) AS n, {r6('max(z)')} AS top FROM ins JOIN mem USING (scan_id, gx, gy) WHERE z < coalesce(low, 1e10) + 2.0 GROUP BY ALL",
    "pts ins",
)
def bev_overhang_filter(spark, d):
    """Each scan's points below the overhang above what the scans before it saw."""
    kept = columns.below_remembered(_inside(spark, d).drop(*KEYS), META, 2.0, "scan_id")
    return rounded(kept.groupBy(F.col("scan_id").cast("long").alias("scan_id"), "gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top")), "top")


#: Numbers of the scans of the test points.
SCANS = range(7)


def _elevation_fold_sql() -> str:
    scan = "(SELECT gx, gy, min(z) AS lo, max(z) AS hi, count(*) AS n FROM ins WHERE scan_id = {} GROUP BY gx, gy)"
    out = f"+m0 AS {scan.format(SCANS[0])}"
    for k in SCANS[1:]:
        out += f", m{k} AS (SELECT gx, gy, least(coalesce(a.lo, b.lo), coalesce(b.lo, a.lo)) AS lo, CASE WHEN a.hi - least(a.lo, b.lo) > 6.0 AND b.hi - b.lo < 6.0 THEN b.hi ELSE greatest(coalesce(a.hi, b.hi), coalesce(b.hi, a.hi)) END AS hi, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM m{k - 1} a FULL JOIN {scan.format(k)} b USING (gx, gy))"
    return out + f" SELECT gx, gy, {r6('lo')} AS min_elevation, {r6('hi')} AS max_elevation, CAST(n AS BIGINT) AS hits FROM m{SCANS[-1]}"


@query(_elevation_fold_sql(), "pts ins")
def bev_elevation_merge(spark, d):
    """Elevations of all scans, folded in order."""
    grids = columns.elevation_grid(_inside(spark, d).drop(*KEYS), META, ("scan_id",))
    return rounded(columns.fold_elevation(grids, 6.0, "scan_id"), "min_elevation", "max_elevation")


@query(f"SELECT e.gx, e.gy, {r6('lo')} AS min_elevation, n AS num_points, {r6('coalesce(f, 0)')} AS f0, coalesce(k, 0) AS num_feature_points FROM {_ELEV} e LEFT JOIN (SELECT gx, gy, avg(f0) AS f, count(*) AS k FROM ins WHERE f0 IS NOT NULL GROUP BY gx, gy) g ON e.gx = g.gx AND e.gy = g.gy", "pts ins")
def bev_map(spark, d):
    inside = _inside(spark, d).drop(*KEYS)
    both = columns.bev_map(columns.elevation_grid(inside, META), columns.bev_from_points(inside, META, ["f0"]), ["f0"])
    return rounded(both.select("gx", "gy", "min_elevation", "num_points", "f0", "num_feature_points"), "min_elevation", "f0")


@query(f"SELECT CAST(k // 40 AS BIGINT) AS gx, CAST(k % 40 AS BIGINT) AS gy, {r6('coalesce(lo, 0.0)')} AS min_elevation FROM (SELECT unnest(range(2000)) AS k) LEFT JOIN {_ELEV} e ON e.gx = k // 40 AND e.gy = k % 40", "pts ins")
def bev_dense(spark, d):
    grid = columns.elevation_grid(_inside(spark, d).drop(*KEYS), META).select("gx", "gy", "min_elevation")
    return rounded(columns.densify(grid, META), "min_elevation")


@query(f"SELECT CAST(k // 40 AS BIGINT) AS gx, CAST(k % 40 AS BIGINT) AS gy, {r6('coalesce(lo, -1.0)')} AS min_elevation, coalesce(n, 0) AS hits FROM (SELECT unnest(range(2000)) AS k) LEFT JOIN {_ELEV} e ON e.gx = k // 40 + 3 AND e.gy = k % 40 - 5", "pts ins")
def bev_shift(spark, d):
    """The map after its origin has moved 3 cells on and 5 cells back; what comes in is -1 without hits."""
    grid = columns.elevation_grid(_inside(spark, d).drop(*KEYS), META).select("gx", "gy", "min_elevation", "hits")
    return rounded(columns.shift(grid, META, (3, -5), {"min_elevation": -1.0, "hits": 0}), "min_elevation")


# Stencils

GAUSS = kernel("gaussian", 2.0, 1.0, 2.0)


def _taps(name: str, taps) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, CAST({w!r} AS DOUBLE))' for i, j, w in taps)}) t(di, dj, w))"


def _near(values: dict[str, str], taps: str, source: str = "bev") -> str:
    sums = ", ".join(f"coalesce(sum({taps}.w * ({v})), 0.0) AS {k}" for k, v in values.items())
    return f"(SELECT c.i, c.j, {sums} FROM {source} c CROSS JOIN {taps} LEFT JOIN {source} n ON n.i = c.i + di AND n.j = c.j + dj GROUP BY c.i, c.j)"


_OFF = [t for t in GAUSS if t[:2] != (0, 0)]


@query(f"+{_taps('k', _OFF)} SELECT i, j, CAST(ok AS DOUBLE) AS z_filtered_mask, CASE WHEN ok THEN {r6('z')} ELSE 0.0 END AS z_filtered FROM (SELECT i, j, z, m > 0 AND (c = 0 OR (z - v / nullif(c, 0) > -0.2 AND z - v / nullif(c, 0) < 0.2)) AS ok FROM bev JOIN {_near({'v': 'n.z * n.m', 'c': 'n.m'}, 'k')} USING (i, j))", "cells bev")
def elevation_filter(spark, d):
    made = stencil.elevation_filter(_bev(spark, d), "z", F.col("m") > 0, GAUSS, -0.2, 0.2)
    return made.select("i", "j", "z_filtered_mask", F.when(F.col("z_filtered_mask") > 0, round6("z_filtered")).otherwise(0.0).alias("z_filtered"))


_FULL = sum(w for *_, w in GAUSS)


@query(f"+{_taps('k', GAUSS)} SELECT i, j, CAST(c > {0.3 * _FULL!r} AS DOUBLE) AS z_inflated_mask, {r6(f'CASE WHEN m <= 0 AND c > {0.3 * _FULL!r} THEN v / c ELSE z END')} AS z_inflated FROM bev JOIN {_near({'v': 'n.z * n.m', 'c': 'n.m'}, 'k')} USING (i, j)", "cells bev")
def terrain_inflation(spark, d):
    return rounded(stencil.inflate(_bev(spark, d), "z", "m", GAUSS, 0.3).select("i", "j", "z_inflated_mask", "z_inflated"), "z_inflated")


def _mrf_sql(rounds: int) -> str:
    out = f"+{_taps('k', _OFF)}, s0 AS (SELECT i, j, z, m, z AS t FROM bev)"
    for n in range(rounds):
        pull = "10.0 * (s.z - s.t) + 1.0 * (v - c * s.t) / (c + 1e-8)"
        out += f", s{n + 1} AS (SELECT i, j, s.z, s.m, CASE WHEN s.m > 0 THEN s.t + 0.05 * ({pull}) ELSE s.t END AS t FROM s{n} s JOIN {_near({'v': 'n.t * n.m', 'c': 'n.m'}, 'k', f's{n}')} USING (i, j))"
    return out + f" SELECT i, j, {r6('t')} AS terrain FROM s{rounds}"


@query(_mrf_sql(3), "cells bev")
def mrf_terrain(spark, d):
    return rounded(stencil.smooth(_bev(spark, d), "z", "m", GAUSS, 3, 10.0, 1.0, 0.05).select("i", "j", "terrain"), "terrain")


def _slope_sql(kind: str) -> str:
    parts = [f"+{_taps('kx', kernel(f'{kind}_x', 1.0, 1.0))}", _taps("ky", kernel(f"{kind}_y", 1.0, 1.0)), _taps("kb", kernel("box", 1.0, 1.0))]
    held = lambda c: f"CASE WHEN b / 9 > 0.9999 THEN greatest(-2.0, least(2.0, {c})) ELSE 0.0 END"
    return ", ".join(parts) + f", g AS (SELECT i, j, {held('sx')} AS slope_x, {held('sy')} AS slope_y FROM {_near({'sx': 'n.z'}, 'kx')} JOIN {_near({'sy': 'n.z'}, 'ky')} USING (i, j) JOIN {_near({'b': 'n.m'}, 'kb')} USING (i, j)) "


@query(_slope_sql("sobel") + f"SELECT i, j, {r6('slope_x')} AS slope_x, {r6('slope_y')} AS slope_y, {r6('sqrt(slope_x * slope_x + slope_y * slope_y)')} AS slope FROM g", "cells bev")
def slope_sobel(spark, d):
    return rounded(stencil.slope(_bev(spark, d), "z", "m", "sobel", 1.0, 1.0, 2.0).select("i", "j", "slope_x", "slope_y", "slope"), "slope_x", "slope_y", "slope")


@query(_slope_sql("scharr") + f"SELECT i, j, {r6('slope_x')} AS slope_x, {r6('slope_y')} AS slope_y FROM g", "cells bev")
def slope_scharr(spark, d):
    return rounded(stencil.slope(_bev(spark, d), "z", "m", "scharr", 1.0, 1.0, 2.0).select("i", "j", "slope_x", "slope_y"), "slope_x", "slope_y")


@query(_slope_sql("sobel") + f"SELECT i, j, {', '.join(r6(f'{c} / sqrt(1 + slope_x * slope_x + slope_y * slope_y)') + f' AS normal_{a}' for a, c in (('x', '-slope_x'), ('y', '-slope_y'), ('z', '1.0')))} FROM g", "cells bev")
def normals_sobel(spark, d):
    made = stencil.normals(stencil.slope(_bev(spark, d), "z", "m", "sobel", 1.0, 1.0, 2.0))
    return rounded(made.select("i", "j", "normal_x", "normal_y", "normal_z"), "normal_x", "normal_y", "normal_z")


@query()
def normals_pca(spark, d):
    return terrain.normals_pca(_bev(spark, d), "z", 1.0)


@query(f"SELECT i, j, {r6('greatest(0.0, least(2.0, top - z))')} AS diff FROM cells", "cells")
def bev_terrain_diff(spark, d):
    return rounded(tables.cells(spark, d).select("i", "j", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("top") - F.col("z"))).alias("diff")), "diff")


_ADJ = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}


@query("SELECT c.i, c.j, " + ", ".join(r6(f"coalesce(n{k}.z, c.z)") + f' AS "{k}"' for k in _ADJ) + " FROM cells c " + " ".join(f"LEFT JOIN cells n{k} ON n{k}.i = c.i + {di} AND n{k}.j = c.j + {dj}" for k, (di, dj) in _ADJ.items()), "cells")
def adjacencies(spark, d):
    return rounded(stencil.adjacencies(tables.cells(spark, d).select("i", "j", "z"), "z").drop("z"), *_ADJ)


@query(f"SELECT a.i, a.j, {r6('0.5 * CASE WHEN a.m > 0 THEN -sqrt(min(CASE WHEN b.m <= 0 THEN power(a.i - b.i, 2) + power(a.j - b.j, 2) END)) ELSE sqrt(min(CASE WHEN b.m > 0 THEN power(a.i - b.i, 2) + power(a.j - b.j, 2) END)) END')} AS sdf FROM bev a CROSS JOIN bev b GROUP BY a.i, a.j, a.m", "cells bev")
def signed_distance(spark, d):
    return rounded(stencil.signed_distance(_bev(spark, d), F.col("m") > 0, 0.5), "sdf")


_POSES = "(SELECT DISTINCT (event_id * 7) % 40 + 0.25 AS px, (event_id * 11) % 40 + 0.75 AS py FROM events)"


@query(f"SELECT i, j, {r6('min(sqrt(power(i + 0.5 - px, 2) + power(j + 0.5 - py, 2)))')} AS distance FROM cells CROSS JOIN {_POSES} p GROUP BY i, j", "cells")
def distance_to_trajectory(spark, d):
    poses = tables.table(spark, d, "events").select((F.col("event_id") * 7 % 40 + 0.25).alias("px"), (F.col("event_id") * 11 % 40 + 0.75).alias("py"))
    return rounded(stencil.nearest_distance(tables.cells(spark, d).select("i", "j"), poses, F.col("i") + 0.5, F.col("j") + 0.5, 4.0), "distance")


@query(f"SELECT i, j, CASE WHEN d <= 0.6 THEN {r6('d')} ELSE 100.0 END AS distance FROM (SELECT i, j, min(sqrt(power(i + 0.5 - px, 2) + power(j + 0.5 - py, 2))) AS d FROM cells CROSS JOIN {_POSES} p GROUP BY i, j)", "cells")
def trajectory_within_reach(spark, d):
    """distance_to_trajectory for users who ask for the surroundings of a path only: cells farther away get a bound."""
    poses = tables.table(spark, d, "events").select((F.col("event_id") * 7 % 40 + 0.25).alias("px"), (F.col("event_id") * 11 % 40 + 0.75).alias("py")).distinct()
    made = stencil.distance_to(tables.cells(spark, d).select("i", "j"), poses, F.col("i") + 0.5, F.col("j") + 0.5, 0.6, 100.0)
    return made.withColumn("distance", F.when(F.col("distance") <= 0.6, round6("distance")).otherwise(F.col("distance")))


@query(f"+{_taps('x5', [(0, 0, 1.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)])}, wide AS (SELECT i, j, CAST(s > 0 AS DOUBLE) AS m FROM {_near({'s': 'n.m'}, 'x5')}), shut AS (SELECT i, j, s > 4.5 AS m FROM {_near({'s': 'n.m'}, 'x5', 'wide')}) SELECT a.i, a.j, a.m AS closed, {r6('0.5 * CASE WHEN a.m THEN -sqrt(min(CASE WHEN NOT b.m THEN power(a.i - b.i, 2) + power(a.j - b.j, 2) END)) ELSE sqrt(min(CASE WHEN b.m THEN power(a.i - b.i, 2) + power(a.j - b.j, 2) END)) END')} AS sdf FROM shut a CROSS JOIN shut b GROUP BY a.i, a.j, a.m", "cells bev")
def closed_distance(spark, d):
    """Signed distance after holes of the mask are closed."""
    shut = stencil.closed(_bev(spark, d), F.col("m") > 0)
    return rounded(stencil.signed_distance(shut, F.col("closed"), 0.5).join(shut.select("i", "j", "closed"), ["i", "j"]), "sdf")


@query()
def terrain_pipeline(spark, d):
    """The shipped order of terrain blocks, from a configuration."""
    return terrain.run(terrain.DEFAULT, _voxels(spark, d).withColumns(META.centres()), 1.0)


# Time


def _clouds(spark, d):
    odo = tables.odometry(spark, d)
    return odo.where("event_type = 'view'"), odo.where("event_type = 'click'")


_ASOF = "l AS (SELECT * FROM odo WHERE event_type = 'view'), r AS (SELECT * FROM odo WHERE event_type = 'click'), m AS (SELECT l.event_id, l.run, l.t, b.t AS bt, b.p AS bp, a.t AS at_, a.p AS ap FROM l ASOF LEFT JOIN r b ON l.run = b.run AND l.t >= b.t ASOF LEFT JOIN r a ON l.run = a.run AND l.t < a.t)"


@query(f"+{_ASOF} SELECT event_id, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bt ELSE at_ END AS match_t, {r6('CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bp ELSE ap END')} AS match_p FROM m", "odo")
def nearest_stamp(spark, d):
    return rounded(temporal.nearest(*_clouds(spark, d), "run", ["p"]).select("event_id", "match_t", "match_p"), "match_p")


@query(f"+{_ASOF} SELECT event_id, {r6('CASE WHEN bt = t THEN bp WHEN at_ - bt <= 864000000000 THEN bp + (t - bt) / (at_ - bt) * (ap - bp) END')} AS at FROM m", "odo")
def interpolated_pose(spark, d):
    return rounded(temporal.interpolate(*_clouds(spark, d), "run", "p", 864_000_000_000).select("event_id", "at"), "at")


@query("SELECT event_id, run, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY t) AS g FROM odo) WHERE g > 3600000000 OR g IS NULL", "odo")
def repeated_stamps(spark, d):
    return temporal.without_repeats(tables.odometry(spark, d), "run", 3_600_000_000).select("event_id", "run", "t")


@query("+l AS (SELECT * FROM odo WHERE event_type = 'view'), s AS (SELECT run, max(lo) AS lo, min(hi) AS hi FROM (SELECT run, event_type, min(t) AS lo, max(t) AS hi FROM odo WHERE event_type IN ('view', 'click') GROUP BY run, event_type) GROUP BY run HAVING count(*) = 2) SELECT event_id, t FROM l JOIN s USING (run) WHERE t BETWEEN lo AND hi", "odo")
def overlap_interval(spark, d):
    return temporal.overlap_clip(*_clouds(spark, d), "run").select("event_id", "t")


@query(f"SELECT run, t, event_id, {r6('p')} AS p FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t DESC, event_id DESC) AS k FROM odo) WHERE k = 1", "odo")
def latest_message(spark, d):
    return rounded(temporal.latest(tables.odometry(spark, d), "run", ["event_id", "p"]), "p")


_IDX = "f AS (SELECT run, p, row_number() OVER (PARTITION BY run ORDER BY t) AS idx FROM odo)"


@query(f"+{_IDX} SELECT a.run, a.idx, coalesce(min(CASE WHEN abs(a.p - b.p) > 120 THEN b.idx END) - 1, max(b.idx)) AS last_idx FROM f a JOIN f b ON a.run = b.run AND b.idx >= a.idx GROUP BY a.run, a.idx", "odo")
def last_overlapping_frame(spark, d):
    frames = temporal.numbered(tables.odometry(spark, d), "run", "idx").select("run", "p", "idx")
    return temporal.last_overlap_any(frames, "run", 60.0)


@query("SELECT event_id FROM (SELECT *, max(CASE WHEN bad >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS s FROM (SELECT *, sum(CASE WHEN p > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad FROM odo)) WHERE s = 0", "odo")
def before_occluded_run(spark, d):
    return temporal.before_run(tables.odometry(spark, d), "run", F.col("p") > 100, 3).select("event_id")


@query(f"SELECT event_id, {r6('avg(p) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS context_mean, {r6('first_value(p) OVER (PARTITION BY run ORDER BY t)')} AS first_value FROM odo", "odo")
def trailing_context(spark, d):
    return rounded(temporal.trailing(tables.odometry(spark, d), "run", "p", 7).select("event_id", "context_mean", "first_value"), "context_mean", "first_value")


@query("SELECT event_id, CAST(k AS BIGINT) AS n FROM (SELECT event_id, count(*) OVER (PARTITION BY run ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 86399999999 FOLLOWING) AS k FROM odo)", "odo")
def accumulation_band(spark, d):
    day = 86_400_000_000
    return temporal.band_counts(tables.odometry(spark, d), "run", day, day - 1, "n").select("event_id", "n")


# Cameras and coordinates

CAMERAS = [
    {"cam": 0, "width": 8, "height": 8, "p": [[4, -4, 0, -20], [4, 0, -4, -80], [1, 0, 0, -25]]},
    {"cam": 1, "width": 8, "height": 8, "p": [[-4, 4, 0, 20], [-4, 0, -4, 120], [-1, 0, 0, 25]]},
]
_PROJ = (
    "cams AS (SELECT * FROM (VALUES (0, 4.0, -4.0, -20.0, 4.0, -4.0, -80.0, 1.0, -25.0), (1, -4.0, 4.0, 20.0, -4.0, -4.0, 120.0, -1.0, 25.0)) t(cam, a, b, c, e, f, g, h, o)), raw AS (SELECT gx, gy, gz, cam, a * x + b * y + c AS u_, e * x + f * z + g AS v_, h * x + o AS depth FROM vox CROSS JOIN cams), "
    "seen AS (SELECT gx, gy, gz, cam, CAST(depth AS DOUBLE) AS depth, CAST(u_ AS DOUBLE) / CAST(depth AS DOUBLE) AS u, CAST(v_ AS DOUBLE) / CAST(depth AS DOUBLE) AS v FROM raw WHERE depth > 0 AND CAST(u_ AS DOUBLE) / depth >= 0 AND CAST(u_ AS DOUBLE) / depth < 8 AND CAST(v_ AS DOUBLE) / depth >= 0 AND CAST(v_ AS DOUBLE) / depth < 8), "
    "px AS (SELECT CAST(vec_id AS INT) AS cam, d % 8 AS pu, d // 8 AS pv, avg(x) AS value FROM (SELECT vec_id % 2 AS vec_id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL)"
)


def _seen(spark, d):
    return pixels.project(_voxels(spark, d).select(*KEYS, "hits").withColumns({a: c for a, c in zip("xyz", META.centres().values(), strict=True)}), CAMERAS)


def _pixels(spark, d):
    """The mean image of either camera: all embeddings are their images in turn."""
    each = tables.descriptors(spark, d).select((F.col("vec_id") % 2).cast("int").alias("cam"), F.posexplode("v").alias("d", "value"))
    return each.groupBy("cam", (F.col("d") % 8).cast("long").alias("pu"), F.floor(F.col("d") / 8).alias("pv")).agg(F.avg("value").alias("value"))


@query(f"+{_PROJ} SELECT gx, gy, gz, cam, {r6('u')} AS u, {r6('v')} AS v, {r6('depth')} AS depth FROM seen", "pts ins vox")
def camera_projection(spark, d):
    return rounded(_seen(spark, d).select(*KEYS, "cam", "u", "v", "depth"), "u", "v", "depth")


@query(f"+{_PROJ} SELECT gx, gy, gz, cam FROM (SELECT *, min(depth) OVER (PARTITION BY cam, floor(u), floor(v)) AS near FROM seen) WHERE depth <= near + 1.0", "pts ins vox")
def occlusion_filter(spark, d):
    return pixels.unoccluded(_seen(spark, d)).select(*KEYS, "cam")


_BIL = "s AS (SELECT gx, gy, gz, cam, sum(w * value) AS value FROM (SELECT gx, gy, gz, cam, CASE WHEN du = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN dv = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS w, greatest(0, least(7, floor(u) + du)) AS pu, greatest(0, least(7, floor(v) + dv)) AS pv FROM seen CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(du, dv)) k JOIN px USING (cam, pu, pv) GROUP BY gx, gy, gz, cam)"


@query(f"+{_PROJ}, {_BIL} SELECT v.gx, v.gy, v.gz, {r6('coalesce(sum(value) / (count(s.cam) + 1e-6), 0.0)')} AS value, count(s.cam) AS n_cams FROM vox v LEFT JOIN s USING (gx, gy, gz) GROUP BY v.gx, v.gy, v.gz", "pts ins vox")
def colorize(spark, d):
    sampled = pixels.bilinear(_seen(spark, d), _pixels(spark, d), [*KEYS, "cam"], "cam", 8, 8)
    return rounded(pixels.colorize(_voxels(spark, d).select(*KEYS), sampled, list(KEYS)), "value")


def _entries(spark, d):
    seen = _seen(spark, d).select("gx", "gy", F.col("hits").cast("int").alias("seq"), "cam", F.floor("u").cast("double").alias("u"), F.floor("v").cast("double").alias("v"), (1 / F.col("depth")).alias("w"))
    return seen.groupBy("gx", "gy", "seq", "cam", "u", "v").agg(F.max("w").alias("w"))


_TOP = f"{_PROJ}, ent AS (SELECT gx, gy, CAST(hits AS INT) AS seq, cam, floor(u) AS u, floor(v) AS v, max(1 / depth) AS w FROM seen JOIN vox USING (gx, gy, gz) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY w DESC, seq, cam, u, v) AS r FROM ent), best AS (SELECT *, w / greatest(sum(w) OVER (PARTITION BY gx, gy), 1e-8) AS share FROM rk WHERE r <= 3)"


@query(f"+{_TOP} SELECT gx, gy, r AS place, seq, cam, u, v, {r6('share')} AS w FROM best", "pts ins vox")
def coordinate_top_k(spark, d):
    top = pixels.top_coords(_entries(spark, d), ["gx", "gy"], 3)
    return rounded(top.select("gx", "gy", F.posexplode("coords").alias("p", "c")).select("gx", "gy", (F.col("p") + 1).cast("long").alias("place"), "c.*"), "w")


@query(f"+{_TOP} SELECT gx, gy, {r6('sum(share * value)')} AS value FROM best JOIN px ON best.cam = px.cam AND best.u = px.pu AND best.v = px.pv GROUP BY gx, gy", "pts ins vox")
def recolor(spark, d):
    return rounded(pixels.recolor(pixels.top_coords(_entries(spark, d), ["gx", "gy"], 3), _pixels(spark, d), ["gx", "gy"]), "value")


@query(f"+{_TOP}, e AS (SELECT seq, cam, sum(share) AS w FROM best GROUP BY seq, cam), s AS (SELECT seq, cam, round(w / sum(w) OVER (), 9) AS share FROM e) SELECT seq, cam, {r6('share')} AS share FROM s", "pts ins vox")
def image_contributions(spark, d):
    return rounded(pixels.contributions(pixels.top_coords(_entries(spark, d), ["gx", "gy"], 3)).drop("cumulative"), "share")


@query()
def coordinate_merge(spark, d):
    entries = _entries(spark, d)
    sides = [pixels.top_coords(entries.where(F.col("cam") == k), ["gx", "gy"], 3) for k in (0, 1)]
    return rounded(pixels.merge_coords(*sides, ["gx", "gy"], 4, 0.5).select("gx", "gy", F.posexplode("coords").alias("p", "c")).select("gx", "gy", "p", "c.*"), "w")


@query(f"SELECT gx, gy, gz, {r6('coalesce((f0 - min(f0) OVER ()) / nullif(max(f0) OVER () - min(f0) OVER (), 0), 0)')} AS f0 FROM vox", "pts ins vox")
def min_max_features(spark, d):
    return rounded(pixels.min_max(_voxels(spark, d).select(*KEYS, "f0"), ["f0"]), "f0")


@query("SELECT p_partkey, CAST(p AS INT) AS packed, round(((p >> 16) & 255) / 255.0 + 1e-9, 6) AS r, round((p & 255) / 255.0 + 1e-9, 6) AS b FROM (SELECT p_partkey, ((p_partkey * 31) % 256) * 65536 + ((p_partkey * 17) % 256) * 256 + p_size AS p FROM part)")
def packed_colours(spark, d):
    at = tables.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 31 % 256 * 65536 + F.col("p_partkey") * 17 % 256 * 256 + F.col("p_size")).cast("int").alias("packed"))
    rgb = geometry.unpack_rgb(F.col("packed"))
    return at.select("p_partkey", "packed", round6(rgb["r"]).alias("r"), round6(rgb["b"]).alias("b"))


# Vectors


@query(f"SELECT label, d, {r6('x')} AS x FROM means", "desc_ means")
def class_means(spark, d):
    return rounded(vectors.class_means(tables.descriptors(spark, d), "label").withColumn("d", F.col("d").cast("long")), "x")


_COS = "cent AS (SELECT label, list(x ORDER BY d) AS c FROM means GROUP BY label), unit AS (SELECT vec_id, label, list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS v FROM desc_), pair AS (SELECT e.vec_id, e.label, c.label AS centre, list_cosine_similarity(e.v, c.c) AS cosine, c.c AS c, e.v AS v FROM unit e CROSS JOIN cent c), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, centre) AS k FROM pair)"


def _centres(spark, d):
    return vectors.as_vectors(vectors.class_means(tables.descriptors(spark, d), "label"), "label")


def _units(spark, d):
    """Descriptors at length 1, as vocabularies take them."""
    return tables.descriptors(spark, d).withColumn("v", geometry.unit(F.col("v")))


@query(f"+{_COS} SELECT vec_id, centre, {r6('cosine')} AS cosine FROM best WHERE k = 1", "desc_ means")
def nearest_centre(spark, d):
    return rounded(vectors.assign(tables.descriptors(spark, d), _centres(spark, d), ["vec_id"]).select("vec_id", "centre", "cosine"), "cosine")


@query(f"+{_COS}, a AS (SELECT label, centre, unnest(range(64)) AS d, unnest(v) - unnest(c) AS x FROM best WHERE k = 1), s AS (SELECT label, centre, d, sum(x) AS x FROM a GROUP BY ALL), n AS (SELECT label, centre, d, x / sqrt(sum(x * x) OVER (PARTITION BY label, centre)) AS x FROM s) SELECT label, centre, d, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY label))')} AS x FROM n", "desc_ means")
def vlad_hard(spark, d):
    assigned = vectors.assign(_units(spark, d), _centres(spark, d), ["vec_id", "label"])
    return rounded(vectors.vlad(assigned, "label").withColumn("d", F.col("d").cast("long")), "x")


@query(f"+{_COS} SELECT vec_id, centre, {r6('list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - c[i])))')} AS residual FROM pair", "desc_ means")
def vlad_residuals(spark, d):
    far = vectors.residuals(_units(spark, d), _centres(spark, d), ["vec_id"])
    return rounded(far.select("vec_id", F.posexplode("residuals").alias("centre", "residual")), "residual")


@query(f"+{_COS} SELECT label AS class_id, count(*) FILTER (WHERE hit) AS intersection, any_value(u) AS union_n, {r6('count(*) FILTER (WHERE hit) / any_value(u)')} AS iou FROM (SELECT p.label, p.label = p.centre AS hit, (SELECT count(*) FROM best q WHERE q.k = 1 AND (q.label = p.label OR q.centre = p.label)) AS u FROM best p WHERE p.k = 1) GROUP BY label", "desc_ means")
def class_iou(spark, d):
    at = vectors.assign(tables.descriptors(spark, d), _centres(spark, d), ["vec_id", "label"])
    return rounded(vectors.confusion(at, "label", "centre"), "iou")


@query(f"+{_COS} SELECT count(*) AS n, {r6('avg(CASE WHEN label = centre THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM best WHERE k = 1", "desc_ means")
def class_accuracy(spark, d):
    at = vectors.assign(tables.descriptors(spark, d), _centres(spark, d), ["vec_id", "label"])
    return rounded(vectors.accuracy(at, "label", "centre"), "accuracy")


@query(f"SELECT a, b, {r6('sum(v[a + 1] * v[b + 1])')} AS g FROM (SELECT CAST(v AS DOUBLE[]) AS v FROM desc_) CROSS JOIN (SELECT unnest(range(64)) AS a) CROSS JOIN (SELECT unnest(range(64)) AS b) WHERE a <= b GROUP BY a, b", "desc_")
def gramian(spark, d):
    return rounded(vectors.gramian(tables.descriptors(spark, d), 64), "g")


@query()
def pca_projection(spark, d):
    rows = tables.descriptors(spark, d)
    mean, basis, _ = vectors.fit_pca(rows, 64, 4)
    return rows.select("vec_id", *(round6(c).alias(f"pca_{k}") for k, c in enumerate(vectors.project(F.col("v"), mean, basis.tolist()))))


@query("SELECT vec_id, round(list_cosine_similarity(v, a) - list_cosine_similarity(v, b) + 1e-9, 6) AS obstacle_score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT [1.0] || list_transform(range(63), lambda i: 0.0) AS a, list_transform(range(64), lambda i: 0.125) AS b)")
def obstacle_scores(spark, d):
    return rounded(vectors.prototype_scores(tables.descriptors(spark, d), [[1.0] + [0.0] * 63], [[0.125] * 64], ["vec_id"]), "obstacle_score")


_EDGE = "edge AS (SELECT a.vec_id AS target, b.vec_id AS source, b.label, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS cos FROM desc_ a JOIN desc_ b ON b.vec_id BETWEEN a.vec_id - 12 AND a.vec_id - 1), topk AS (SELECT *, exp(cos / 0.1) AS w FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cos DESC, source) AS r FROM edge) WHERE r <= 5), vote AS (SELECT target, label, sum(w) AS w FROM topk GROUP BY target, label)"


@query(f"+{_EDGE} SELECT target, arg_max(label, w) AS voted, {r6('max(w) / sum(w)')} AS share FROM vote GROUP BY target", "desc_")
def label_propagation(spark, d):
    rows = tables.descriptors(spark, d)
    near = rows.select(F.col("vec_id").alias("target"), F.col("v").alias("a"), F.explode(F.sequence(F.col("vec_id") - 12, F.col("vec_id") - 1)).alias("source"))
    edges = near.join(rows.select(F.col("vec_id").alias("source"), "label", F.col("v").alias("b")), "source")
    cos = geometry.cosine(F.col("a"), F.col("b"))
    return rounded(vectors.propagate(edges.select("target", "source", "label", cos.alias("cos")), "target", "label", 5), "share")


# Covariances


def _covariances(spark, d):
    noise = {"cov_xx": F.col("f0") + 0.01, "cov_xy": F.lit(0.001), "cov_xz": F.lit(0.0), "cov_yy": F.col("f1") + 0.02, "cov_yz": F.lit(0.002), "cov_zz": F.col("f0") + F.col("f1") + 0.01}
    return _inside(spark, d).where("f0 is not null").withColumns(noise)


def _inverse_sql(m: list[str]) -> list[str]:
    """Six entries of the inverse of a symmetric matrix, 1e-6 added to its diagonal."""
    a, b, c, d, e, f = (f"({x} + 1e-6)" if k in (0, 3, 5) else f"({x})" for k, x in enumerate(m))
    return [f"(({x}) / ({_determinant_sql([a, b, c, d, e, f])}))" for x in (f"{d} * {f} - {e} * {e}", f"{c} * {e} - {b} * {f}", f"{b} * {e} - {c} * {d}", f"{a} * {f} - {c} * {c}", f"{b} * {c} - {a} * {e}", f"{a} * {d} - {b} * {b}")]


def _determinant_sql(m: list[str]) -> str:
    a, b, c, d, e, f = (f"({x})" for x in m)
    return f"{a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {c} * {e}) + {c} * ({b} * {e} - {c} * {d})"


_SIX = [f"c_{k}" for k in covariance.SIX]
_COV = "c AS (SELECT *, f0 + 0.01 AS c_xx, 0.001::DOUBLE AS c_xy, 0.0::DOUBLE AS c_xz, f1 + 0.02 AS c_yy, 0.002::DOUBLE AS c_yz, f0 + f1 + 0.01 AS c_zz FROM ins WHERE f0 IS NOT NULL), lim AS (SELECT quantile_cont(c_xx + c_yy + c_zz, 0.99) AS q FROM c)"


def _fused_sql(source: str, key: str) -> str:
    """CTEs ending in `fused`: covariance of the mean precision, weighted centre and mean feature of each key."""
    p = _inverse_sql(_SIX)
    full = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
    six = covariance.SIX
    sums = ", ".join([f"avg(p_{k}) AS c_{k}" for k in six] + [f"avg({' + '.join(f'p_{six[full[r][c]]} * {a}' for c, a in enumerate('xyz'))}) AS b{r}" for r in range(3)])
    centre = ", ".join(f"{' + '.join(f'v_{six[full[r][c]]} * b{c}' for c in range(3))} AS m_{a}" for r, a in enumerate("xyz"))
    return (
        f"prec AS (SELECT {key}, x, y, z, f0, {', '.join(f'{v} AS p_{k}' for k, v in zip(six, p, strict=True))} FROM {source}), mean AS (SELECT {key}, avg(f0) AS f, {sums} FROM prec GROUP BY {key}), "
        f"inv AS (SELECT *, {', '.join(f'{v} AS v_{k}' for k, v in zip(six, _inverse_sql(_SIX), strict=True))} FROM mean), fused AS (SELECT {key}, f, {', '.join(f'v_{k}' for k in six)}, {centre} FROM inv)"
    )


_SHOWN = ", ".join([f"{r6('f')} AS f0", *(f"{r6(f'v_{k}')} AS cov_{k}" for k in covariance.SIX), *(f"{r6(f'm_{a}')} AS center_{a}" for a in "xyz")])


def _covariance_fold_sql() -> str:
    six, shown = covariance.SIX, ["f", *(f"v_{k}" for k in covariance.SIX), *(f"m_{a}" for a in "xyz")]
    out = f"+{_COV}, {_fused_sql('c', 'scan_id, gx, gy, gz')}, t{SCANS[0]} AS (SELECT * EXCLUDE (scan_id) FROM fused WHERE scan_id = {SCANS[0]})"
    for n in SCANS[1:]:
        sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in shown)
        weight = {s: f"exp(-0.5 * (3 * ln(2 * pi()) + ln({_determinant_sql([f'{s}_v_{k} + 1e-6' if k in ('xx', 'yy', 'zz') else f'{s}_v_{k}' for k in six])})))" for s in "ab"}
        half = {s: _inverse_sql([f"{s}_v_{k}" for k in six]) for s in "ab"}
        halves = ", ".join(f"0.5 * {a} + 0.5 * {b} AS h_{k}" for k, a, b in zip(six, half["a"], half["b"], strict=True))
        joint = [("f", "(wa * a_f + wb * b_f) / (wa + wb + 1e-6)"), *zip([f"v_{k}" for k in six], _inverse_sql([f"h_{k}" for k in six]), strict=True), *((f"m_{a}", f"(a_m_{a} + b_m_{a}) / 2") for a in "xyz")]
        out += f", j{n} AS (SELECT gx, gy, gz, {sides} FROM t{n - 1} a FULL JOIN (SELECT * FROM fused WHERE scan_id = {n}) b USING (gx, gy, gz)), w{n} AS (SELECT *, {weight['a']} AS wa, {weight['b']} AS wb, {halves} FROM j{n})"
        out += f", t{n} AS (SELECT gx, gy, gz, {', '.join(f'coalesce({v}, a_{c}, b_{c}) AS {c}' for c, v in joint)} FROM w{n})"
    return out + f" SELECT gx, gy, gz, {_SHOWN} FROM t{SCANS[-1]}"


@query(f"+{_COV} SELECT gx, gy, gz, count(*) AS n, {r6('avg(f0)')} AS f0 FROM c, lim WHERE c_xx + c_yy + c_zz <= q + 1e-6 GROUP BY gx, gy, gz", "pts ins")
def covariance_outliers(spark, d):
    kept = covariance.without_outliers(_covariances(spark, d), "cov", slack=1e-6)
    return rounded(kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("f0").alias("f0")), "f0")


@query(f"+{_COV}, few AS (SELECT c.* FROM c, lim WHERE c_xx + c_yy + c_zz <= q + 1e-6 AND c_xx > 0 AND c_xx * c_yy - c_xy * c_xy > 0 AND {_determinant_sql(_SIX)} > 0), {_fused_sql('few', 'gx, gy, gz')} SELECT gx, gy, gz, {_SHOWN} FROM fused", "pts ins")
def covariance_voxels(spark, d):
    rows = covariance.without_outliers(_covariances(spark, d), "cov", slack=1e-6).where(covariance.positive(covariance.of("cov")))
    made = covariance.fuse_points(rows, list(KEYS), "cov", ["f0"])
    return rounded(made, *(c for c in made.columns if c not in KEYS))


@query(_covariance_fold_sql(), "pts ins")
def covariance_merge(spark, d):
    """Covariance voxels of all scans, merged in order."""
    per_scan = covariance.fuse_points(_covariances(spark, d), ["scan_id", *KEYS], "cov", ["f0"])
    made = covariance.merge_all(per_scan, list(KEYS), ["f0"], "scan_id")
    return rounded(made, *(c for c in made.columns if c not in KEYS))


# Sinks, samples and summaries


@query(f"SELECT layer, i, j, {r6('v')} AS v, CAST((39 - j) * 40 + (39 - i) AS BIGINT) AS place FROM (SELECT i, j, 'z' AS layer, z AS v FROM cells UNION ALL SELECT i, j, 'top', top FROM cells)", "cells")
def grid_map_layers(spark, d):
    long = tables.cells(spark, d).unpivot(["i", "j"], ["z", "top"], "layer", "v")
    return rounded(long.withColumn("place", (39 - F.col("j")) * 40 + 39 - F.col("i")), "v").select("layer", "i", "j", "v", "place")


@query(f"+m AS (SELECT i, j, m > 0 AS seen, z, top FROM bev JOIN cells USING (i, j, z, top)), l AS (SELECT i, j, seen, 'z' AS layer, z AS v FROM m UNION ALL SELECT i, j, seen, 'top', top FROM m UNION ALL SELECT i, j, true, 'elevation', 2.5 - 1.73 FROM m) SELECT layer, CAST((39 - j) * 40 + (39 - i) AS BIGINT) AS place, NOT seen AS masked, CASE WHEN seen THEN {r6('v')} END AS v FROM l", "cells bev")
def grid_map_message(spark, d):
    """Layers of a map as its message holds them: NaN outside the mask, and a layer of one height."""
    message = columns.grid_map(_bev(spark, d), ["z", "top"], 40, 40, F.col("m") > 0, {"elevation": 2.5 - 1.73})
    each = message.select("layer", F.posexplode("values").alias("place", "v")).where("v is not null")
    return each.select("layer", F.col("place").cast("long").alias("place"), F.isnan("v").alias("masked"), F.when(~F.isnan("v"), round6(F.col("v"))).alias("v"))


@query(f"+rg AS (SELECT scan_id, sqrt({_D}) AS r FROM pts) SELECT scan_id, count(*) AS n, {r6('min(r)')} AS nearest, {r6('max(r)')} AS farthest FROM rg WHERE r > 5.0 AND r < 20.0 GROUP BY scan_id", "pts")
def range_gate(spark, d):
    """Points of each scan between five and twenty metres from the sensor."""
    kept = rays.range_gate(tables.points(spark, d), SENSOR, 5.0, 20.0)
    return rounded(kept.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.min("range").alias("nearest"), F.max("range").alias("farthest")), "nearest", "farthest")


@query("SELECT CAST(least(99, floor((l_extendedprice - 0) / 1100)) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return tables.table(spark, d, "lineitem").groupBy(F.least(F.lit(99), F.floor(F.col("l_extendedprice") / 1100)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM (SELECT event_id, run, row_number() OVER (PARTITION BY run ORDER BY t) AS k FROM odo) WHERE (k - 2) % 5 = 0 AND k >= 2", "odo")
def stride_sample(spark, d):
    return temporal.strided(tables.odometry(spark, d), "run", 2, 5).select("event_id")


@query(f"SELECT scan_id, gx, count(*) AS n, {r6('avg(z)')} AS mean_z, {r6('stddev_samp(z)')} AS std_z FROM ins GROUP BY ROLLUP (scan_id, gx)", "pts ins")
def error_summary(spark, d):
    made = _inside(spark, d).select(F.col("scan_id").cast("long").alias("scan_id"), "gx", "z").rollup("scan_id", "gx").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("std_z"))
    return rounded(made, "mean_z", "std_z")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_properties(spark, d):
    at = tables.table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return at.where("k > 50")


@query("SELECT user_id, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour_us, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, d):
    hour = 3_600_000_000
    at = tables.odometry(spark, d).withColumn("hour_us", F.floor(F.col("t") / hour).cast("long") * hour)
    return at.groupBy(F.col("run").alias("user_id"), "hour_us").agg(F.count(F.lit(1)).alias("n"))


# The same queries under the names that they had while these had a cap.
for _name in ("last_overlapping_frame", "distance_to_trajectory"):
    QUERIES[f"{_name}_any"], ORACLE_SQL[f"{_name}_any"] = QUERIES[_name], ORACLE_SQL[_name]

from . import details, fitting, images, motion, spatial, sweeps, vocabulary  # noqa: E402, F401  (their queries enter themselves)
