"""Boxes in three dimensions, distances by envelopes, the quadtree of poses, and splatted images against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.grid import GridMeta
from terravox.operators import boxes, rays, stencil

AXES = ("x", "y", "z")


def random_frames(rng, n, runs=2, empty=0.0):
    """Boxes that wander, so that overlaps last for some frames."""
    rows = []
    for run in range(runs):
        at = [rng.uniform(-5, 5) for _ in AXES]
        for idx in range(1, n + 1):
            at = [c + rng.uniform(-1.5, 1.5) for c in at]
            box = [e for c in at for e in (round(c, 1), round(c + rng.choice((3.0, 4.0)), 1))]
            rows.append((run, idx, *([None] * 6 if rng.random() < empty else box)))
    return rows


SCHEMA = "run long, idx long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"


def meet(a, b):
    return None not in a + b and all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (0, 2, 4))


@pytest.mark.parametrize(("n", "fan", "empty"), [(40, 2, 0.0), (40, 3, 0.1), (300, 16, 0.02), (1, 2, 0.0)])
def test_last_overlap_in_three_dimensions(spark, monkeypatch, n, fan, empty):
    monkeypatch.setattr(boxes, "FAN", fan)
    rows = random_frames(random.Random(n + fan), n, empty=empty)
    got = {(r.run, r.idx): r.last_idx for r in boxes.last_overlap(spark.createDataFrame(rows, SCHEMA), "run", AXES).collect()}
    by = {(r[0], r[1]): r[2:] for r in rows}
    want = {}
    for run, idx in by:
        last = idx
        while meet(by[run, idx], by.get((run, last), (None,))) and (run, last + 1) in by and meet(by[run, idx], by[run, last + 1]):
            last += 1
        want[run, idx] = last
    assert got == want


def test_volume_forgets_what_it_leaves(spark):
    """There and back: cells that are left and met again start anew; a feature outlives scans without it."""
    place = [0, 1, 2, 9, 9, 1, 0]
    volumes = [(1, k + 1, *(e for a in AXES for e in ((p - 2, p + 2) if a == "x" else (-9, 9)))) for k, p in enumerate(place)]
    seen = [(1, 1, 0, 0, 0, 5.0), (1, 2, 0, 0, 0, None), (1, 3, 0, 0, 0, 6.0), (1, 6, 0, 0, 0, None), (1, 7, 0, 0, 0, 8.0), (1, 4, 0, 0, 0, 7.0), (1, 4, 9, 0, 0, 1.0)]
    integers = SCHEMA.replace("double", "long")
    out = boxes.remembered(spark.createDataFrame(seen, "run long, idx long, gx long, gy long, gz long, f double"), spark.createDataFrame(volumes, integers), "run", AXES, ["f"])
    got = sorted((r.gx, r.idx, r.until, r.hits, r.first_idx, r.f) for r in out.collect())
    assert got == [(0, 1, 4, 1, 1, 5.0), (0, 2, 4, 2, 1, 5.0), (0, 3, 4, 3, 1, 6.0), (0, 6, None, 1, 6, None), (0, 7, None, 2, 6, 8.0), (9, 4, 6, 1, 4, 1.0)]
    frames = spark.createDataFrame([(1, k + 1, *(e for a in AXES for e in ((p - 1, p + 1) if a == "x" else (-3, 3)))) for k, p in enumerate(place)], integers)
    held = boxes.supervision(frames, spark.createDataFrame(seen, "run long, idx long, gx long, gy long, gz long, f double"), spark.createDataFrame(volumes, integers), "run", AXES, ["f"])
    assert sorted((r.idx, r.gx, r.hits, r.f) for r in held.collect()) == [(1, 0, 3, 6.0), (2, 0, 3, 6.0), (4, 9, 1, 1.0), (5, 9, 1, 1.0), (6, 0, 2, 8.0), (7, 0, 2, 8.0)]


@pytest.mark.parametrize(("fan", "pairs", "asking", "size"), [(2, 7, 4, 3), (3, 1 << 20, 64, 16), (16, 50, 4096, 256)])
def test_supervision_in_blocks_and_slices(spark, monkeypatch, fan, pairs, asking, size):
    """Runs over several blocks, slices and pieces, against a volume that is moved frame by frame."""
    for name, value in (("FAN", fan), ("PAIRS", pairs), ("ASKING", asking)):
        monkeypatch.setattr(boxes, name, value)
    rng, frames, volumes, seen, want = random.Random(fan), [], [], {}, {}
    for run, n in ((1, 70), (2, 1), (3, 23)):
        at, p = [], 0
        for _ in range(n):
            p += rng.choice((-2, -1, 0, 0, 1, 2))
            at.append(p)
        box = lambda q, w: tuple(e for a in AXES for e in ((q - w, q + w) if a == "x" else (-w, w)))
        frames += [(run, k + 1, *box(q, 1)) for k, q in enumerate(at)]
        volumes += [(run, k + 1, *box(q, 4)) for k, q in enumerate(at)]
        for k, q in enumerate(at):
            for _ in range(3):
                seen[run, k + 1, q + rng.randint(-5, 5), rng.randint(-1, 1), 0] = rng.choice((None, rng.random()))
        states, state = [], {}
        for k, q in enumerate(at):
            for (r, i, *c), f in seen.items():
                if (r, i) == (run, k + 1):
                    h, first, before = state.get(tuple(c), (0, i, None))
                    state[tuple(c)] = h + 1, first, before if f is None else f
            state = {c: v for c, v in state.items() if abs(c[0] - q) <= 4}
            states.append(dict(state))
        for k, q in enumerate(at):
            end = k
            while end + 1 < n and abs(at[end + 1] - q) <= 2:
                end += 1
            want |= {(run, k + 1, *c): v for c, v in states[end].items() if abs(c[0] - q) <= 1 and abs(c[1]) <= 1}
    integers = SCHEMA.replace("double", "long")
    rows = spark.createDataFrame([(*k, f) for k, f in seen.items()], "run long, idx long, gx long, gy long, gz long, f double")
    out = boxes.supervision(spark.createDataFrame(frames, integers), rows, spark.createDataFrame(volumes, integers), "run", AXES, ["f"], slice_frames=size).collect()
    assert len(out) == len(want) and {tuple(r[:5]): (r.hits, r.first_idx, r.f) for r in out} == want


def test_supervision_shuffles_no_row_a_frame_and_cell(spark):
    """A vehicle that stands still among 400 cells: 300 frames hold 120,000 of them."""
    integers = SCHEMA.replace("double", "long")
    frames = spark.createDataFrame([(1, k + 1, *(e for _ in AXES for e in (0, 19))) for k in range(300)], integers)
    seen = spark.createDataFrame([(1, 1 + k % 9, k % 20, k // 20, 0, 1.0) for k in range(400)], "run long, idx long, gx long, gy long, gz long, f double")
    jvm = spark.sparkContext._jvm
    written = lambda: sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = written()
    assert boxes.supervision(frames, seen, frames, "run", AXES, ["f"]).count() == 120_000
    assert written() - before < 20_000


def test_envelope_is_the_minimum():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(60), rng.randint(1, 20)))
        heights = [rng.choice((0, 1, 4, 9, 400, rng.randint(0, 2000))) for _ in places]
        kept, begin = stencil.envelope(places, heights)
        for i in range(-10, 80):
            at = max(k for k in range(len(kept)) if begin[k] is None or begin[k] <= i)
            assert (i - places[kept[at]]) ** 2 + heights[kept[at]] == min((i - p) ** 2 + h for p, h in zip(places, heights, strict=True))


@pytest.mark.parametrize(("share", "tall"), [(0.02, 5), (0.3, 7), (0.98, 4096), (0.5, 1)])
def test_signed_distance_over_tiles(spark, share, tall):
    """A map whose columns are cut into tiles that exchange what can be nearest."""
    rng = random.Random(tall)
    cells = [(i - 20, j, rng.random() < share) for i in range(45) for j in range(37)]
    df = spark.createDataFrame(cells, "i int, j int, m boolean")
    got = {(r.i, r.j): r.sdf for r in stencil.signed_distance(df, F.col("m"), 0.5, tall).collect()}
    kinds = {m: np.array([(i, j) for i, j, k in cells if k == m]) for m in (True, False)}
    assert len(got) == len(cells)
    for i, j, m in cells:
        far = 0.5 * math.sqrt(((kinds[not m] - (i, j)) ** 2).sum(1).min())
        assert abs(got[i, j] - (-far if m else far)) < 1e-9


def test_signed_distance_of_one_kind_and_of_nothing(spark):
    df = spark.createDataFrame([(i, j, True) for i in range(3) for j in range(3)], "i long, j long, m boolean")
    assert [r.sdf for r in stencil.signed_distance(df, F.col("m"), 1.0).collect()] == [None] * 9
    assert stencil.signed_distance(df.where("false"), F.col("m"), 1.0).count() == 0


def test_second_step_has_a_row_a_cell(spark):
    """No cell meets the rest of its column: the rows after the envelopes are the cells and what is left of the parabolas."""
    df = spark.range(300 * 300).selectExpr("id div 300 i", "id % 300 j").withColumn("m", (F.col("i") * 7 + F.col("j") * 3) % 11 == 0)
    out = stencil.signed_distance(df, F.col("m"), 1.0)
    out.collect()
    text = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text and "CartesianProduct" not in text
    assert out.count() == 90_000


def test_nearest_pose_of_crowds(spark):
    """Poses in one crowd, on one spot and far away; leaves of few poses; every distance is exact."""
    rng = np.random.default_rng(0)
    poses = np.concatenate([rng.normal(3.3, 1e-3, (400, 2)), rng.normal(3.3, 1e-4, (100, 2)), rng.uniform(-100, 100, (60, 2)), [[4000.0, -4000.0]], np.full((30, 2), 7.0)])
    cells = [(i, j) for i in range(-3, 7) for j in range(-3, 7)]
    df = spark.createDataFrame(cells, "i long, j long")
    at = spark.createDataFrame([(float(x), float(y)) for x, y in poses] + [(None, 1.0)], "px double, py double")
    for leaf in (16, 64):
        got = {(r.i, r.j): r.distance for r in stencil.nearest_distance(df, at, F.col("i") + 0.5, F.col("j") + 0.5, 4.0, leaf).collect()}
        for i, j in cells:
            assert abs(got[i, j] - np.hypot(poses[:, 0] - i - 0.5, poses[:, 1] - j - 0.5).min()) < 1e-9
    none = stencil.nearest_distance(df, at.where("false"), F.col("i") + 0.5, F.col("j") + 0.5, 4.0).collect()
    assert len(none) == 100 and all(r.distance is None for r in none)


def test_a_crowded_square_is_no_all_pairs_join(spark):
    """100,000 poses in one square: a cell is compared with a bounded number of them."""
    poses = spark.range(100_000).select((F.rand(1) * 4).alias("px"), (F.rand(2) * 4).alias("py"))
    cells = spark.range(400).selectExpr("id div 20 i", "id % 20 j")
    tree = stencil.quadtree(stencil.written(poses, "poses"), 4.0)
    at = cells.select("i", "j", (F.col("i") * 0.2).alias("_x"), (F.col("j") * 0.2).alias("_y"))
    leaves = sum(near.count() for near in stencil.near_leaves(at, tree))
    assert sum(held.count() for held in tree[2]) == 100_000
    assert leaves * stencil.LEAF < 400 * 2_000, leaves


def test_beams_hold_what_lies_just_above_their_lower_edge(spark):
    """A beam's bin begins a quarter of a degree below it and holds half a degree; gaps between beams hold nothing."""
    model = rays.SensorModel.named("vlp32c")
    want = {-25.2: 0, -24.9: 0, -24.7: None, -25.3: None, 0.05: 19, -0.2: 19, 0.1: 20, 5.0: None, 7.1: 29, 15.1: 31, 15.3: None}
    df = spark.createDataFrame([(float(e),) for e in want], "e double")
    got = {r.e: r.bin for r in df.select("e", model.bin(F.radians("e"), F.lit(0.001)).alias("bin")).collect()}
    assert {e: None if b is None else b // 900 for e, b in got.items()} == want
    assert rays.SensorModel.named("generic", el=(-1.0, 1.0, 2), az=(0.0, 9.0, 3)).el_edges is None
    with pytest.raises(ValueError, match="unknown"):
        rays.SensorModel.named("other")


def test_splat_of_one_voxel(spark):
    """A voxel ahead fills the bins of its sub-points; one behind it shows where the first does not reach."""
    meta = GridMeta((0.0, 0.0, 0.0), (40.0, 40.0, 40.0), (1.0, 1.0, 1.0))
    voxels = spark.createDataFrame([(20, 10, 10, 1.0, 5.0), (38, 10, 10, 3.0, 5.0)], "gx long, gy long, gz long, f0 double, f1 double")
    model, sensor = rays.SensorModel((-10.0, 10.0, 20), (-10.0, 10.0, 20)), (10.5, 10.4, 10.4)
    got = {r.bin: r for r in rays.splat(voxels, model, sensor, meta.centres(), meta.resolution, ["f0", "f1"]).collect()}
    points = [(x + 0.25 * a, 10.5 + 0.25 * b, 10.5 + 0.25 * c, f) for x, f in ((20.5, 0.0), (38.5, 1.0)) for a in range(5) for b in range(5) for c in range(5)]
    # Both voxels' centres share one bin, so only the nearer one is spread.
    want = {}
    for x, y, z, f in points[:125]:
        dx, dy, dz = x - sensor[0], y - sensor[1], z - sensor[2]
        el, az, r = math.degrees(math.atan2(dz, math.hypot(dx, dy))), math.degrees(math.atan2(dy, dx)), math.sqrt(dx * dx + dy * dy + dz * dz)
        b = (math.ceil(el + 10) - 1) * 20 + math.ceil(az + 10) - 1
        want[b] = min(want.get(b, (1e9, 0)), (r, f))
    assert set(got) == set(want) and all(abs(got[b].depth - want[b][0]) < 1e-9 and got[b].f0 == want[b][1] and got[b].f1 == 0.0 for b in want)


def test_splat_makes_its_voxels_once(spark):
    """What voxels come from, a costly aggregation of points, is in no part of the image's plan."""
    meta = GridMeta((0.0, 0.0, 0.0), (40.0, 40.0, 40.0), (1.0, 1.0, 1.0))
    points = spark.range(1000).selectExpr("20 gx", "id % 10 gy", "10 gz", "cast(id as double) f0")
    voxels = points.groupBy("gx", "gy", "gz").agg(F.stddev_samp("f0").alias("f0"))
    image = rays.splat(voxels, rays.SensorModel((-30.0, 30.0, 20), (-30.0, 30.0, 20)), (10.5, 5.4, 10.4), meta.centres(), meta.resolution, ["f0"])
    assert image.count() > 0 and "stddev" not in image._jdf.queryExecution().optimizedPlan().toString()
