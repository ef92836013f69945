"""Queries over poses, calibrated cameras, footprints and overlapping boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry
from ..grid import KEYS
from ..operators import pixels, poses, temporal
from ..sources import tables
from ..sources.tables import META, SENSOR, round6
from .registry import MODEL, _bin_sql, _D, _inside, _voxels, query, r6, rounded

#: SQL of poses: each event is one, turned about the upright axis.
_POSES = "pose AS (SELECT event_id, user_id AS run, epoch_us(ts) AS t, event_type, value AS px, value / 2 AS py, CAST(event_id % 5 AS DOUBLE) AS pz, sin((event_id % 628) / 200.0) AS qz, cos((event_id % 628) / 200.0) AS qw FROM events)"


def _poses(spark, d):
    half = (F.col("event_id") % 628) / 200.0
    at = tables.odometry(spark, d).withColumnRenamed("p", "px")
    return at.withColumns({"py": F.col("px") / 2, "pz": (F.col("event_id") % 5).cast("double"), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(half), "qw": F.cos(half)})


_C, _S = "(qw * qw - qz * qz)", "(2 * qz * qw)"


@query(f"WITH {_POSES} SELECT event_id, {r6(f'{_C} * 1.0 - {_S} * 2.0 + px')} AS x, {r6(f'{_S} * 1.0 + {_C} * 2.0 + py')} AS y, {r6('3.0 + pz')} AS z, 1.0::DOUBLE AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z FROM pose")
def pose_round_trip(spark, d):
    """A point of the vehicle in the world, by quaternions that are not of unit length, and back."""
    at = _poses(spark, d)
    m = geometry.pose_matrix(tuple(F.col(c) for c in poses.POSITION), tuple(F.col(c) * 3.0 for c in poses.TURN))
    there = geometry.transform((F.lit(1.0), F.lit(2.0), F.lit(3.0)), m)
    back = geometry.transform(there, geometry.rigid_inverse(m))
    named = [f"{b}{a}" for b in ("", "back_") for a in "xyz"]
    return at.select("event_id", *(round6(c).alias(n) for n, c in zip(named, (*there, *back), strict=True)))


def _around(name: str, left: str, kind: str) -> str:
    """CTE with the poses of a kind at or before (b) and after (a) each row of left, and the pose between them."""
    fields = ("px", "py", "pz", "qz", "qw")
    cols = lambda s: ", ".join(f"{s}.{c} AS {s}_{c}" for c in ("t", *fields))
    w = "(l_t - b_t) / nullif(a_t - b_t, 0)"
    arc = "acos(least(1.0, abs(b_qz * a_qz + b_qw * a_qw)))"
    sign = "CASE WHEN b_qz * a_qz + b_qw * a_qw < 0 THEN -1.0 ELSE 1.0 END"
    weight = lambda s: f"CASE WHEN {arc} < 1e-6 THEN {s} ELSE sin(({s}) * {arc}) / sin(greatest({arc}, 1e-6)) END"
    lerp = [f"b_{c} + {w} * (a_{c} - b_{c})" for c in fields[:3]]
    slerp = [f"({weight(f'1 - {w}')}) * b_{c} + ({weight(w)}) * ({sign}) * a_{c}" for c in fields[3:]]
    at = ", ".join(f"CASE WHEN b_t = l_t THEN b_{c} WHEN a_t - b_t <= 864000000000 THEN {v} END AS {name}_{c}" for c, v in zip(fields, (*lerp, *slerp), strict=True))
    return f"{name}_r AS (SELECT * FROM pose WHERE event_type = '{kind}'), {name}_m AS (SELECT l.event_id, l.t AS l_t, {cols('b')}, {cols('a')} FROM {left} l ASOF LEFT JOIN {name}_r b ON l.run = b.run AND l.t >= b.t ASOF LEFT JOIN {name}_r a ON l.run = a.run AND l.t < a.t), {name} AS (SELECT event_id, {at} FROM {name}_m)"


@query(f"WITH {_POSES}, v AS (SELECT * FROM pose WHERE event_type = 'view'), {_around('o', 'v', 'click')} SELECT event_id, {', '.join(f'{r6(f'o_{c}')} AS {c}' for c in ('px', 'py', 'pz', 'qz', 'qw'))} FROM o")
def pose_at_stamps(spark, d):
    at = _poses(spark, d)
    made = poses.at_stamps(at.where("event_type = 'view'").select("event_id", "run", "t"), at.where("event_type = 'click'"), "run", 864_000_000_000)
    return rounded(made.select("event_id", "px", "py", "pz", "qz", "qw"), "px", "py", "pz", "qz", "qw")


_OC, _OS = "(o_qw * o_qw - o_qz * o_qz)", "(2 * o_qz * o_qw)"


@query(f"WITH {_POSES}, v AS (SELECT * FROM pose WHERE event_type = 'view'), {_around('o', 'v', 'click')}, {_around('i', 'v', 'error')} SELECT event_id, {r6(f'{_OC} * i_px - {_OS} * i_py + o_px')} AS px, {r6(f'{_OS} * i_px + {_OC} * i_py + o_py')} AS py, {r6('i_pz + o_pz')} AS pz, {r6('o_qw * i_qz + o_qz * i_qw')} AS qz, {r6('o_qw * i_qw - o_qz * i_qz')} AS qw FROM o JOIN i USING (event_id) WHERE o_px IS NOT NULL AND i_px IS NOT NULL")
def transform_lookup(spark, d):
    """Clouds whose two transforms are known at their stamp, and both in a chain."""
    at = _poses(spark, d)
    kinds = [at.where(F.col("event_type") == k) for k in ("view", "click", "error")]
    made = poses.looked_up(kinds[0].select("event_id", "run", "t"), kinds[1], kinds[2], "run", 864_000_000_000)
    return rounded(made.select("event_id", "px", "py", "pz", "qz", "qw"), "px", "py", "pz", "qz", "qw")


_AZ, _EL = "(step / 99.0 * 2 * pi())", "(sin(step / 99.0 * 4 * pi()) * pi() / 6)"
_RZ, _RW = f"(qz * cos({_AZ} / 2) + qw * sin({_AZ} / 2))", f"(qw * cos({_AZ} / 2) - qz * sin({_AZ} / 2))"


@query(f"WITH {_POSES}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t DESC, event_id DESC) AS k FROM pose) WHERE k = 1), s AS (SELECT *, unnest(range(100)) AS step FROM last) SELECT run, CAST(step AS INT) AS step, {r6('px')} AS px, {r6(f'-{_RZ} * sin({_EL} / 2)')} AS qx, {r6(f'{_RW} * sin({_EL} / 2)')} AS qy, {r6(f'{_RZ} * cos({_EL} / 2)')} AS qz, {r6(f'{_RW} * cos({_EL} / 2)')} AS qw FROM s")
def render_path(spark, d):
    """A camera's way around the latest pose of each run."""
    last = temporal.latest(_poses(spark, d), "run", ["event_id", *poses.POSITION, *poses.TURN])
    return rounded(poses.render_path(last).select("run", "step", "px", "qx", "qy", "qz", "qw"), "px", "qx", "qy", "qz", "qw")


#: A camera that looks along x: its numbers and where it stands.
_K, _E = [4.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 0.0, 1.0], np.array([[0, -1, 0, 20.0], [0, 0, -1, 5.0], [1, 0, 0, -25.0], [0, 0, 0, 1]])
_MOVED = [np.array([[1, 0, 0, dx], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]]) for dx in (0.5, 0.0)]


@query(f"SELECT gx, gy, gz, {r6('4 * (20 - y) / (x - 24.5) + 4')} AS u, {r6('4 * (5 - z) / (x - 24.5) + 4')} AS v FROM vox WHERE x > 24.5 AND 4 * (20 - y) / (x - 24.5) + 4 >= 0 AND 4 * (20 - y) / (x - 24.5) + 4 < 8 AND 4 * (5 - z) / (x - 24.5) + 4 >= 0 AND 4 * (5 - z) / (x - 24.5) + 4 < 8", "pts ins vox")
def calibrated_camera(spark, d):
    """Voxels in a camera given by intrinsics and extrinsics, the latter set right for half a metre between cloud and image."""
    extrinsics = _E @ geometry.corrected_extrinsics(*_MOVED, np.eye(4))
    p = geometry.projection(geometry.intrinsics(_K), extrinsics)
    centres = {a: c for a, c in zip("xyz", META.centres().values(), strict=True)}
    seen = pixels.project(_voxels(spark, d).select(*KEYS).withColumns(centres), [{"cam": 0, "width": 8, "height": 8, "p": p.tolist()}])
    return rounded(seen.select(*KEYS, "u", "v"), "u", "v")


_PLAN = ", ".join(f"({x!r}::DOUBLE, {y!r}::DOUBLE)" for x in (-1.3, 0.0, 1.3) for y in (-0.7, 0.7))
_PX, _PY = "(px % 50)", "(py % 40)"


@query(
    f"+{_POSES}, depth AS (SELECT {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, min(sqrt({_D})) AS near FROM ins GROUP BY 1), "
    f"plan AS (SELECT * FROM (VALUES {_PLAN}) f(fx, fy)), spot AS (SELECT event_id, {_C} * fx - {_S} * fy + {_PX} AS x, {_S} * fx + {_C} * fy + {_PY} AS y, 0.3 + pz AS z FROM pose CROSS JOIN plan), "
    f"seen AS (SELECT event_id, {_bin_sql('x - 25.0', 'y - 20.0', 'z - 5.0')} AS bin, sqrt({_D}) AS r FROM spot) "
    f"SELECT event_id, count(*) AS n_seen, {r6('avg(CASE WHEN near > 1e-6 AND r > near + 1.0 THEN 1.0 ELSE 0.0 END)')} AS occluded FROM seen LEFT JOIN depth USING (bin) WHERE bin IS NOT NULL GROUP BY event_id",
    "pts ins",
)
def footprint_occlusion(spark, d):
    at = _poses(spark, d).withColumns({"px": F.col("px") % 50, "py": F.col("py") % 40})
    made = poses.occluded_share(at, poses.footprint(2.6, 1.4, 3, 2, 0.3), _inside(spark, d), MODEL, SENSOR, 1.0, ["event_id"])
    return rounded(made, "occluded")


@query(f"WITH {_POSES}, s AS (SELECT event_id, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2) + power(pz - lag(pz) OVER w, 2)) / ((t - lag(t) OVER w) / 1e6) AS speed FROM pose WINDOW w AS (PARTITION BY run ORDER BY t)) SELECT event_id, round(speed + 1e-9, 6) AS speed FROM s WHERE speed >= 0.001")
def motion_gate(spark, d):
    """Poses that move by a millimetre a second or more."""
    return rounded(poses.speeds(_poses(spark, d), "run").where("speed >= 0.001").select("event_id", "speed"), "speed")


_CAMERAS = [[[0.0, -1.0, 0.0, 20.0], [0.0, 0.0, -1.0, 5.0], [1.0, 0.0, 0.0, -25.0]], [[0.0, 1.0, 0.0, -20.0], [0.0, 0.0, -1.0, 6.0], [-1.0, 0.0, 0.0, 24.5]]]
_BEFORE = "q AS (SELECT *, qw * qw - qz * qz AS c, 2 * qz * qw AS s, lag(px) OVER w AS ox, lag(py) OVER w AS oy, lag(pz) OVER w AS oz, lag(qw * qw - qz * qz) OVER w AS oc, lag(2 * qz * qw) OVER w AS os FROM pose WINDOW w AS (PARTITION BY run ORDER BY t)), k AS (SELECT *, c * oc + s * os AS tc, s * oc - c * os AS ts FROM q WHERE ox IS NOT NULL), m AS (SELECT *, px - (tc * ox - ts * oy) AS mx, py - (ts * ox + tc * oy) AS my, pz - oz AS mz FROM k)"
_ENTRIES = [f"e{r}{c}" for r in range(3) for c in range(4)]


def _camera_sql(cam: int, e: list[list[float]]) -> str:
    rows = [[f"tc * {e[0][c]!r} - ts * {e[1][c]!r}" for c in range(4)], [f"ts * {e[0][c]!r} + tc * {e[1][c]!r}" for c in range(4)], [f"{e[2][c]!r}" for c in range(4)]]
    for r, move in enumerate(("mx", "my", "mz")):
        rows[r][3] += f" + {move}"
    return f"SELECT event_id, {cam} AS cam, {', '.join(f'{r6(f'CAST({v} AS DOUBLE)')} AS {n}' for v, n in zip((v for row in rows for v in row), _ENTRIES, strict=True))} FROM m"


@query(f"WITH {_POSES}, {_BEFORE} {' UNION ALL '.join(_camera_sql(k, e) for k, e in enumerate(_CAMERAS))}")
def frame_extrinsics(spark, d):
    """Extrinsics of both cameras at each pose, set right for the way since the pose before it, at which the cloud was taken."""
    names = [*poses.POSITION, *poses.TURN]
    order = {f"o_{c}": (lambda c: lambda w: F.lag(c).over(w))(c) for c in names}
    both = temporal.looking_back(_poses(spark, d), "run", 1, order).where("o_px is not null")
    at = lambda p: geometry.pose_matrix(tuple(F.col(p + c) for c in poses.POSITION), tuple(F.col(p + c) for c in poses.TURN))
    cameras = spark.createDataFrame([(k, [v for row in e for v in row]) for k, e in enumerate(_CAMERAS)], "cam int, e array<double>")
    given = [[F.col("e")[4 * r + c] for c in range(4)] for r in range(3)] + [[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]]
    made = geometry.frame_extrinsics(at("o_"), at(""), given)
    return both.crossJoin(F.broadcast(cameras)).select("event_id", "cam", *(round6(v).alias(n) for v, n in zip((v for row in made[:3] for v in row), _ENTRIES, strict=True)))


_FRAMES = "f AS (SELECT run, p, event_id, row_number() OVER (PARTITION BY run ORDER BY t) AS idx FROM odo), o AS (SELECT a.run, a.idx, any_value(a.p) AS p, coalesce(min(CASE WHEN abs(a.p - b.p) > 120 THEN b.idx END) - 1, max(b.idx)) AS last_idx FROM f a JOIN f b ON a.run = b.run AND b.idx >= a.idx GROUP BY a.run, a.idx)"


@query(f"+{_FRAMES}, seen AS (SELECT run, idx, CAST(floor((p + event_id % 81 - 40) / 20) AS BIGINT) AS cell, CAST(event_id % 100 AS DOUBLE) AS f FROM f) SELECT o.run, o.idx, seen.cell, arg_max(seen.f, seen.idx) AS f FROM o JOIN seen ON o.run = seen.run AND seen.idx <= o.last_idx AND seen.cell BETWEEN floor((o.p - 60) / 20) AND floor((o.p + 60) / 20) GROUP BY o.run, o.idx, seen.cell", "odo")
def inpainting_supervision(spark, d):
    """What each frame's box holds in the end, of all frames up to the last that overlaps it."""
    frames = temporal.numbered(tables.odometry(spark, d), "run", "idx").select("run", "p", "event_id", "idx")
    cell = F.floor((F.col("p") + F.col("event_id") % 81 - 40) / 20).cast("long")
    seen = frames.select("run", "idx", cell.alias("cell"), (F.col("event_id") % 100).cast("double").alias("f"))
    ends = frames.join(temporal.last_overlap_any(frames.select("run", "idx", "p"), "run", 60.0), ["run", "idx"])
    return poses.supervision(ends, seen, "run", 60.0, 20.0, "f")


@query()
def footprint_mask(spark, d):
    """Pixels of the way ahead of every fiftieth pose that moves, over the poses of its run; the cloud is that of all scans."""
    at = _poses(spark, d).withColumns({"px": F.col("px") % 50, "py": F.col("py") % 40, "pz": F.lit(1.0)})
    images = temporal.strided(poses.speeds(at, "run").where("speed >= 1e-6"), "run", 1, 50)
    # Bounded by the grid: at most its cells.
    near = _inside(spark, d).groupBy(*KEYS).agg(*(F.avg(c).alias(c) for c in "xyz"))
    square = lambda x, y: F.struct(F.floor(F.col(x) / 25).cast("int").alias("x"), F.floor(F.col(y) / 20).cast("int").alias("y")).alias("square")
    camera = {"cam": 0, "width": 64, "height": 64, "p": (geometry.projection(geometry.intrinsics([40.0, 0, 32.0, 0, 40.0, 32.0, 0, 0, 1]), np.array([[0, -1, 0, 0.0], [0, 0, -1, 0.0], [1, 0, 0, 0.0], [0, 0, 0, 1]]))).tolist()}
    clouds = F.broadcast(near.select(square("x", "y"), *"xyz"))
    return poses.footprint_pixels(images.select("*", F.col("event_id").alias("image"), square("px", "py")), at, clouds, poses.footprint(2.6, 1.4, 3, 2, -0.9), MODEL, camera, "run", "image", on="square", steps=50, step_us=3_600_000_000, gap_us=864_000_000_000, rows_below=60.0)
