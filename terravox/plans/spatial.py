"""Queries over boxes in three dimensions, volumes that move, splatted images, and maps that follow a vehicle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grid import GridMeta
from ..operators import boxes, rays, temporal
from ..sources import tables
from ..sources.tables import META, SENSOR, round6
from ..sources.working import written
from ..streaming import ticks
from .registry import MODEL, _bin_sql, _D, _voxels, query, r6

AXES = ("x", "y", "z")
#: Cells of a frame's box on each axis, and sides of a cell.
_BOX, _CELL = {"x": 6, "y": 8, "z": 4}, {"x": 20.0, "y": 10.0, "z": 1.0}
_AT = {"x": "p", "y": "p / 2", "z": "event_id % 5"}
#: A frame's box in cells, the same box with its far edges, and the volume of three boxes a side around it.
_LOW = {a: f"CAST(floor(({_AT[a]}) / {_CELL[a]}) AS BIGINT) - {_BOX[a] // 2}" for a in AXES}
_FRAMES = f"fr AS (SELECT run, event_id, p, row_number() OVER (PARTITION BY run ORDER BY t) AS idx, {', '.join(f'{v} AS lo_{a}' for a, v in _LOW.items())} FROM odo)"
_APART = " OR ".join(f"a.lo_{k} > b.lo_{k} + {n} OR b.lo_{k} > a.lo_{k} + {n}" for k, n in _BOX.items())
_LAST = f"ends AS (SELECT a.run, a.idx, coalesce(min(CASE WHEN {_APART} THEN b.idx END) - 1, max(b.idx)) AS last_idx FROM fr a JOIN fr b ON a.run = b.run AND b.idx >= a.idx GROUP BY a.run, a.idx)"


def _frames(spark, d):
    at = temporal.numbered(tables.odometry(spark, d), "run", "idx").select("run", "event_id", "p", "idx")
    return written(at.withColumns({f"lo_{a}": F.expr(v) for a, v in _LOW.items()}), "frames")


def _sized(frames, times: int, more: int):
    """Boxes of so many times the size around each frame's own, with the last cell moved on by `more`."""
    ends = {f"lo_{a}": F.col(f"lo_{a}") - (times - 1) // 2 * n for a, n in _BOX.items()}
    return frames.select("run", "idx", *(v.alias(k) for k, v in ends.items()), *((ends[f"lo_{a}"] + times * n - 1 + more).alias(f"hi_{a}") for a, n in _BOX.items()))


@query(f"+{_FRAMES}, {_LAST} SELECT * FROM ends", "odo")
def last_overlapping_box(spark, d):
    """The last frame, without a gap, whose box in three dimensions touches each frame's."""
    return boxes.last_overlap(_sized(_frames(spark, d), 1, 1), "run", AXES)


_SEEN_AT = {"x": "p + (event_id * (k + 3)) % 81 - 40", "y": "p / 2 + (event_id * (k + 5)) % 41 - 20", "z": "event_id % 5 + k - 1"}
_CELLS = {f"g{a}": f"CAST(floor(({_SEEN_AT[a]}) / {_CELL[a]}) AS BIGINT)" for a in AXES}
_HELD = " AND ".join(f"g{a} >= fr.lo_{a} - {n} AND g{a} < fr.lo_{a} + {2 * n}" for a, n in _BOX.items())
_INSIDE = " AND ".join(f"g{a} >= fr.lo_{a} AND g{a} < fr.lo_{a} + {n}" for a, n in _BOX.items())


@query(
    f"+{_FRAMES}, {_LAST}, sn AS (SELECT run, idx, gx, gy, gz, max(f0) AS f0 FROM (SELECT run, idx, {', '.join(f'{v} AS {k}' for k, v in _CELLS.items())}, CASE WHEN event_id % 3 <> k THEN CAST((event_id * (k + 1)) % 100 AS DOUBLE) END AS f0 FROM fr, (SELECT unnest(range(3)) AS k)) GROUP BY ALL), "
    f"until AS (SELECT sn.run, sn.idx, gx, gy, gz, any_value(f0) AS f0, min(CASE WHEN NOT ({_HELD}) THEN fr.idx END) AS gone FROM sn JOIN fr ON fr.run = sn.run AND fr.idx >= sn.idx GROUP BY ALL) "
    f"SELECT fr.run, fr.idx, gx, gy, gz, count(*) AS hits, min(u.idx) AS first_idx, arg_max(u.f0, u.idx) FILTER (WHERE u.f0 IS NOT NULL) AS f0 FROM fr JOIN ends USING (run, idx) JOIN until u ON u.run = fr.run AND u.idx <= last_idx AND (gone IS NULL OR gone > last_idx) AND {_INSIDE} GROUP BY ALL",
    "odo",
)
def box_supervision(spark, d):
    """What the volume around the vehicle holds of each frame's box once all frames that overlap it have passed."""
    frames = _frames(spark, d)
    at = frames.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    feature = F.when(F.col("event_id") % 3 != F.col("k"), (F.col("event_id") * (F.col("k") + 1) % 100).cast("double"))
    seen = at.select("run", "idx", *(F.expr(v).alias(k) for k, v in _CELLS.items()), feature.alias("f0")).groupBy("run", "idx", "gx", "gy", "gz").agg(F.max("f0").alias("f0"))
    return boxes.supervision(_sized(frames, 1, 0), written(seen, "seen"), _sized(frames, 3, 0), "run", AXES, ["f0"], _sized(frames, 1, 1))


_SHARES = "(SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS s)"


@query(
    f"+vat AS (SELECT x, y, z, f0, f1, top, {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM (SELECT x, y, z, f0, f1, max_z AS top FROM vox WHERE f0 IS NOT NULL)), low AS (SELECT bin, min(r) AS q FROM vat WHERE bin IS NOT NULL GROUP BY bin), "
    f"front AS (SELECT x, y, z, f0, f1, top FROM vat JOIN low USING (bin) WHERE abs(r - q) < 1e-6), sub AS (SELECT x + a.s * 1.0 AS x, y + b.s * 1.0 AS y, z + c.s * 0.5 AS z, f0, f1, top FROM front, {_SHARES} a, {_SHARES} b, {_SHARES} c), "
    f"sat AS (SELECT f0, f1, top, {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM sub), ties AS (SELECT bin, round(r, 6) AS q, min(r) AS depth, avg(f0) AS f0, avg(f1) AS f1, avg(top) AS top FROM sat WHERE bin IS NOT NULL GROUP BY ALL), span AS (SELECT min(f0) AS a0, max(f0) AS b0, min(f1) AS a1, max(f1) AS b1, min(top) AS a2, max(top) AS b2 FROM vat) "
    f"SELECT bin, {r6('depth')} AS depth, {r6('greatest(0.0, least(1.0, (f0 - a0) / (b0 - a0)))')} AS red, {r6('greatest(0.0, least(1.0, (f1 - a1) / (b1 - a1)))')} AS green, {r6('greatest(0.0, least(1.0, (top - a2) / (b2 - a2)))')} AS blue FROM ties, span WHERE q = (SELECT min(q) FROM ties t WHERE t.bin = ties.bin)",
    "pts ins vox",
)
def splat_render(spark, d):
    """Depth and colours of the voxels seen from the sensor, each spread over its cell."""
    known = _voxels(spark, d).where("f0 is not null").select("gx", "gy", "gz", "f0", "f1", F.col("max_z").alias("top"))
    image = rays.splat(known, MODEL, SENSOR, META.centres(), META.resolution, ["f0", "f1", "top"])
    return image.select("bin", *(round6(c).alias(n) for c, n in (("depth", "depth"), ("f0", "red"), ("f1", "green"), ("top", "blue"))))


# Maps that follow a vehicle

_TICKS, _BASE = range(1, 8), GridMeta((-15.0, -12.0, -5.0), (30.0, 24.0, 10.0), (1.0, 1.0, 0.5))
_POSE = {"x": "20.13 + 2.2 * tick + run", "y": "16.21 + 1.3 * tick - run", "z": "5.17 + 0.4 * tick"}
_FIRST = {a: f"CAST(round((p{a} - {-o!r}) / {r!r}) AS BIGINT)" for a, o, r in zip(AXES, _BASE.origin, _BASE.resolution, strict=True)}
_IN_BOX = " AND ".join(f"g{a} >= low_{a} AND g{a} < low_{a} + {n}" for a, n in zip(AXES, _BASE.n, strict=True))
_OFF = [f"({c} - p{a})" for a, c in zip(AXES, ("x", "y", "z"), strict=True)]
_OFF_CELL = ["(gx + 0.5 - px)", "(gy + 0.5 - py)", "((gz + 0.5) * 0.5 - pz)"]
_DIST = lambda off: " + ".join(f"{c} * {c}" for c in off)


def _ticks_sql() -> str:
    """The map after the last tick: each tick's crop, rays, merge and cull is a step that names the one before."""
    steps = [
        "tp AS (SELECT CAST(l_linenumber % 3 AS BIGINT) AS run, CAST(year(l_shipdate) - 1994 AS BIGINT) AS tick, l_quantity - 0.5 AS x, (l_partkey % 40) + 0.5 AS y, l_extendedprice / 10000.0 AS z, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS f0, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS f1 FROM lineitem)",
        f"po AS (SELECT run, tick, {', '.join(f'CAST({v} AS DOUBLE) AS p{a}' for a, v in _POSE.items())} FROM (SELECT DISTINCT run, tick FROM tp))",
        f"pl AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS low_{a}' for a, v in _FIRST.items())} FROM po)",
        f"pb AS MATERIALIZED (SELECT tp.*, pl.* EXCLUDE (run, tick), CAST(floor(x) AS BIGINT) AS gx, CAST(floor(y) AS BIGINT) AS gy, CAST(floor(z / 0.5) AS BIGINT) AS gz, {_DIST(_OFF)} AS d2, {_bin_sql(*_OFF)} AS bin FROM tp JOIN pl USING (run, tick))",
        "rb AS MATERIALIZED (SELECT run, tick, bin, max(sqrt(d2)) AS far FROM pb WHERE bin > 0 GROUP BY ALL)",
        f"nb AS (SELECT *, min(CASE WHEN f0 IS NOT NULL THEN d2 END) OVER (PARTITION BY run, tick, gx, gy, gz) AS best FROM pb WHERE {_IN_BOX})",
        "nv AS MATERIALIZED (SELECT run, tick, gx, gy, gz, min(z) AS lo, max(z) AS hi, avg(f0) FILTER (WHERE d2 = best AND f0 IS NOT NULL) AS f0 FROM nb GROUP BY ALL)",
        "s0 AS (SELECT run, gx, gy, gz, 0.0 AS hits, 0.0 AS misses, lo, hi, 0.0 AS one, 0.0 AS two, f0 FROM nv WHERE false)",
    ]
    for t in _TICKS:
        steps += [
            f"c{t} AS (SELECT s.*, px, py, pz FROM s{t - 1} s JOIN pl ON pl.run = s.run AND pl.tick = {t} WHERE {_IN_BOX})",
            f"v{t} AS (SELECT *, sqrt({_DIST(_OFF_CELL)}) AS r, {_bin_sql(*_OFF_CELL)} AS bin FROM c{t})",
            f"r{t} AS (SELECT v.* EXCLUDE (misses, px, py, pz, r, bin), misses + CASE WHEN v.bin IS NOT NULL AND r < coalesce(far, 200.0) THEN 1.0 ELSE 0.0 END AS misses FROM v{t} v LEFT JOIN rb ON rb.run = v.run AND rb.tick = {t} AND rb.bin = v.bin)",
            f"m{t} AS (SELECT run, gx, gy, gz, coalesce(a.hits, 0) + CASE WHEN b.lo IS NULL THEN 0.0 ELSE 1.0 END AS hits, coalesce(a.misses, 0.0) AS misses, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, coalesce(a.one, {t}.0) AS one, CASE WHEN b.lo IS NULL THEN a.two ELSE {t}.0 END AS two, coalesce(0.5 * a.f0 + 0.5 * b.f0, b.f0, a.f0) AS f0 FROM r{t} a FULL JOIN (SELECT * FROM nv WHERE tick = {t}) b USING (run, gx, gy, gz))",
            f"s{t} AS MATERIALIZED (SELECT * EXCLUDE (low) FROM (SELECT *, min(gz) OVER (PARTITION BY run, gx, gy) AS low FROM m{t}) WHERE misses / (hits + misses) <= 0.75 OR gz = low)",
        ]
    return f"WITH {', '.join(steps)} SELECT run, gx, gy, gz, CAST(hits AS DOUBLE) AS hits, CAST(misses AS DOUBLE) AS misses, {r6('lo')} AS min_z, {r6('hi')} AS max_z, CAST(one AS DOUBLE) AS first_update, CAST(two AS DOUBLE) AS last_update, {r6('f0')} AS f0 FROM s{_TICKS[-1]}"


@query(_ticks_sql())
def voxel_ticks(spark, d):
    """Maps of three vehicles that move while they scan: each tick moves, raytraces, merges and culls."""
    run = F.col("l_linenumber") % 3
    lines = tables.table(spark, d, "lineitem").withColumns({"run": run.cast("long"), "tick": (F.year("l_shipdate") - 1994).cast("long")})
    points = tables.scan_points(lines, "run", "tick")
    poses = lines.select("run", "tick").distinct().select("run", "tick", F.col("tick").alias("stamp"), *(F.expr(v).cast("double").alias(f"p{a}") for a, v in _POSE.items()))
    live = ticks.VoxelTicks(_BASE, ("f0", "f1"), 0.5, 8, MODEL)
    made = live.fold(live.table_messages(points, written(poses, "poses")))
    names = ("min_z", "max_z", "f0")
    return made.select("run", "gx", "gy", "gz", "hits", "misses", "first_update", "last_update", *(round6(F.nanvl(n, F.lit(None).cast("double"))).alias(n) for n in names))
