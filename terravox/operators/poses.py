"""Poses (position px, py, pz and quaternion qx, qy, qz, qw) of vehicles, and what a vehicle's footprint and boxes meet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Cols, pose_matrix, rigid_inverse, to_spherical, transform
from ..sources.working import written
from . import pixels, rays, temporal

POSITION, TURN = ("px", "py", "pz"), ("qx", "qy", "qz", "qw")
DAY = temporal.DAY


def product(a: Cols, b: Cols) -> Cols:
    """Quaternion of the turn b followed by the turn a."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def at_stamps(left: DataFrame, poses: DataFrame, key: str, gap_us: int, slice_us: int = DAY) -> DataFrame:
    """left with the pose at its stamp: positions linearly, turns along the arc between the two poses around it.

    Null before the first pose, after the last and across gaps longer than gap_us.
    """
    fields = [*POSITION, *TURN]
    both = temporal.neighbours(left, poses, key, fields, slice_us)
    b, a = F.col("_b"), F.col("_a")
    share = (F.col("t") - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0))
    between = [b[c] + share * (a[c] - b[c]) for c in POSITION] + temporal.slerp([b[c] for c in TURN], [a[c] for c in TURN], share)
    near = a["t"] - b["t"] <= gap_us
    return both.select(*left.columns, *(F.when(b["t"] == F.col("t"), b[c]).when(near, v).alias(c) for c, v in zip(fields, between, strict=True)))


def looked_up(left: DataFrame, outer: DataFrame, inner: DataFrame, key: str, gap_us: int, slice_us: int = DAY) -> DataFrame:
    """Rows of left at whose stamp both transforms are known, with the pose of the inner one as the outer one sees it."""
    one = at_stamps(left, outer, key, gap_us, slice_us).where("px is not null")
    one = one.withColumnsRenamed({c: f"_o{c}" for c in (*POSITION, *TURN)})
    both = at_stamps(one, inner, key, gap_us, slice_us).where("px is not null")
    turn = tuple(F.col(f"_o{c}") for c in TURN)
    moved = transform(tuple(F.col(c) for c in POSITION), pose_matrix(tuple(F.col(f"_o{c}") for c in POSITION), turn))
    turned = product(turn, tuple(F.col(c) for c in TURN))
    return both.select(*left.columns, *(v.alias(c) for c, v in zip((*POSITION, *TURN), (*moved, *turned), strict=True)))


def render_path(poses: DataFrame, n: int = 100) -> DataFrame:
    """n poses for each: once around in azimuth, twice up and down by 30 degrees, as step 0 .. n - 1."""
    share = F.col("step") / (n - 1)
    az, el = share * (2 * math.pi), F.sin(share * (4 * math.pi)) * (math.pi / 6)
    zero = F.lit(0.0)
    turn = product((zero, zero, F.sin(az / 2), F.cos(az / 2)), (zero, F.sin(el / 2), zero, F.cos(el / 2)))
    out = product(tuple(F.col(c) for c in TURN), turn)
    steps = poses.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return steps.withColumns({f"_{c}": v for c, v in zip(TURN, out, strict=True)}).drop(*TURN).withColumnsRenamed({f"_{c}": c for c in TURN})


def footprint(length: float, width: float, nl: int, nw: int, dz: float = 0.0) -> Column:
    """The lattice of nl x nw points of a vehicle's ground plan, as one array of points."""
    along = lambda size, n: [size * (k / (n - 1) - 0.5) for k in range(n)]
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(dz).alias("z")) for x in along(length, nl) for y in along(width, nw)))


def occluded_share(poses: DataFrame, plan: Column, cloud: DataFrame, model: rays.SensorModel, sensor: tuple[float, ...], slack: float, keys: list[str]) -> DataFrame:
    """For each pose: how many points of its plan lie in the sensor's view, and the share of them behind what the cloud returned.

    The depth image is the nearest range of each bin, a table bounded by the sensor's bins; poses out of view are left out.
    """
    depth = rays.bin_ranges(cloud, model, sensor, F.min)
    spread = poses.withColumn("_p", F.explode(plan))
    xyz = transform(tuple(F.col(f"_p.{a}") for a in "xyz"), pose_matrix(tuple(F.col(c) for c in POSITION), tuple(F.col(c) for c in TURN)))
    at = rays.local(spread, sensor, *xyz).withColumn("bin", model.bin(F.col("el"), F.col("az"))).where("bin is not null")
    hidden = (F.col("bin_range") > 1e-6) & (F.col("range") > F.col("bin_range") + slack)
    met = at.join(F.broadcast(depth), "bin", "left").withColumn("_h", F.coalesce(hidden, F.lit(False)).cast("double"))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seen"), F.avg("_h").alias("occluded"))


def supervision(frames: DataFrame, seen: DataFrame, key: str, half: float, side: float, field: str, slice_frames: int = 256) -> DataFrame:
    """Rows (key, idx, cell, field): what a box holds once all frames that overlap it have passed, the latest frame's value first.

    frames: key, idx, p, last_idx; seen: key, idx, cell, field, at most one row each. A box asks each of its cells, which
    its size bounds, for the last value up to last_idx: an as-of lookup by cell, so that no frame meets all others.
    """
    inside = F.sequence(F.floor((F.col("p") - half) / side).cast("long"), F.floor((F.col("p") + half) / side).cast("long"))
    asked = frames.select(key, "idx", F.col("last_idx").alias("t"), F.explode(inside).alias("cell"))
    at = lambda df: df.withColumn("_at", F.struct(key, "cell"))
    found = temporal.at_or_before(at(asked), at(seen.withColumnRenamed("idx", "t")).select("_at", "t", field), "_at", [field], slice_frames)
    return found.where("_found is not null").select(key, "idx", "cell", F.col(f"_found.{field}").alias(field))


def before_hidden_run(poses: DataFrame, key: str, share: float, longest: int) -> DataFrame:
    """Poses of a path up to its first run of `longest` in a row whose occluded share is above the limit."""
    return temporal.before_run(poses, key, F.col("occluded") > share, longest)


def speeds(rows: DataFrame, key: str, slice_us: int = DAY) -> DataFrame:
    """rows with speed: metres a second from the row before by stamp; null for a key's first."""

    def speed(order):
        way = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) ** 2 for c in POSITION), F.lit(0.0)))
        return way / F.nullif((F.col("t") - F.lag("t").over(order)) / 1e6, F.lit(0.0))

    return temporal.looking_back(rows, key, 1, {"speed": speed}, slice_us)


#: Images whose clouds one task puts into bins.
IMAGES_A_TASK = 256


def footprint_pixels(images: DataFrame, path: DataFrame, clouds: DataFrame, plan: Column, model: rays.SensorModel, camera: dict, key: str, image: str, *, on: str | None = None, steps: int = 1000, step_us: int = 100_000, gap_us: int = DAY, slack: float = 1.0, share: float = 0.9, longest: int = 10, rows_below: float | None = None) -> DataFrame:
    """Rows (image, u, v): pixels that a vehicle's footprint covers on the way ahead of each image, as far as it is seen.

    images: image, key, t and the pose at t; path: key, t and poses; clouds: image, x, y, z in the world; camera: as in
    pixels.project, for points in the image's own frame. With `on`, a column of images and clouds, an image sees all points of its
    value, and clouds need no column image: a cloud that many images share is never copied for each; a small one may come as F.broadcast. The plan is
    put at poses every step_us after the image's stamp, as far as the path is known. A point is hidden behind the nearest return of its
    bin by more than slack. The way ends before the step that makes `longest` in a row with more than `share` of the points in view
    hidden; steps without a point in view count for nothing. Pixel rows from rows_below on are the vehicle's own and left out.
    """
    pose = [*POSITION, *TURN]
    matrix = pose_matrix(tuple(F.col(c) for c in POSITION), tuple(F.col(c) for c in TURN))
    # Matrices are made once a pose, as columns of twelve numbers, ahead of the points that they move.
    kept = lambda m: F.array(*(v for row in m[:3] for v in row))
    rows = lambda c: [[F.col(c)[4 * r + k] for k in range(4)] for r in range(3)]
    own = written(images.select(F.col(image).alias("_image"), F.col(on or image).alias("_on"), key, F.col("t").alias("_t0"), kept(rigid_inverse(matrix)).alias("_in")), "images")
    xyz = tuple(F.col(c) for c in "xyz")
    # Made once a row: a plain column would be put, in full, into each place of the next formula that names it.
    once = lambda df, values: df.withColumn("_w", F.explode(F.array(F.struct(*(v.alias(c) for c, v in values.items()))))).withColumns({c: F.col(f"_w.{c}") for c in values}).drop("_w")

    def seen(points: DataFrame) -> DataFrame:
        """x, y, z in the image's frame, with range and bin."""
        at = once(once(points, dict(zip("xyz", transform(xyz, rows("_in")), strict=True))), to_spherical(*xyz))
        return at.withColumn("bin", model.bin(F.col("el"), F.col("az")))

    # Dealt by image: a task has all returns of its images, which no shuffle moves before they are one range a bin.
    dealt = own.select("_image", "_on", "_in").repartition(-(-own.count() // IMAGES_A_TASK) or 1, "_image")
    returns = dealt.join(clouds.withColumnRenamed(on or image, "_on"), "_on")
    depth = seen(returns).where("bin is not null").groupBy("_image", "bin").agg(F.min("range").alias("_near"))
    ahead = own.select("_image", key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.col("_t0") + k * step_us)).alias("_step", "t"))
    placed = at_stamps(ahead, path, key, gap_us).where("px is not null").select("_image", "_step", kept(matrix).alias("_out"))
    spread = placed.join(own.select("_image", "_in"), "_image").withColumn("_p", F.explode(plan))
    world = transform(tuple(F.col(f"_p.{c}") for c in "xyz"), rows("_out"))
    put = spread.withColumns(dict(zip("xyz", world, strict=True))).select("_image", "_step", "_in", *"xyz")
    hidden = F.coalesce((F.col("_near") > 1e-6) & (F.col("range") > F.col("_near") + slack), F.lit(False))
    points = seen(put).select("_image", "_step", *"xyz", "range", "bin").join(depth, ["_image", "bin"], "left").withColumn("_hidden", hidden)
    inside = F.when(F.col("bin").isNotNull(), F.col("_hidden").cast("double"))
    each = points.groupBy("_image", "_step").agg(F.avg(inside).alias("occluded"), F.collect_list(F.when(~F.col("_hidden"), F.struct(*"xyz"))).alias("_shown")).where("occluded is not null")
    # At most `steps` rows an image: small enough for an ordered window.
    order = Window.partitionBy("_image").orderBy("_step")
    streak = each.withColumn("_b", F.sum((F.col("occluded") > share).cast("int")).over(order.rowsBetween(-(longest - 1), 0)) >= longest)
    way = streak.withColumn("_stop", F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not _stop").select("_image", F.explode("_shown").alias("_p"))
    shown = pixels.project(way.select("_image", "_p.*"), [camera])
    cells = shown.select(F.col("_image").alias(image), F.floor("u").cast("long").alias("u"), F.floor("v").cast("long").alias("v")).distinct()
    return cells if rows_below is None else cells.where(F.col("v") < rows_below)
