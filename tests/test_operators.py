"""Laws and analytic truths of the operators, and the registered queries against their SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.grid import FeatureKeys, GridMeta, kernel
from terravox.operators import columns, covariance, poses, rays, stencil, temporal, voxel
from terravox.plans import registry, terrain
from terravox.streaming.mapper import VoxelMap

META = GridMeta((-2.0, -1.0, 0.0), (4.0, 3.0, 2.0), (0.5, 0.25, 0.5))


def cloud(spark, n=500, seed=37):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform((-2.2, -1.2, -0.2), (2.2, 2.2, 2.2), (n, 3))
    return spark.createDataFrame([(*map(float, p), float(k % 7) if k % 2 else None) for k, p in enumerate(xyz)], "x double, y double, z double, f double")


def test_voxel_iff_point_and_round_trip(spark):
    made = voxel.voxelize(cloud(spark), META, ["f"], F.lit(1.5), "mindist", (0.0, 0.0, 0.0))
    rows = made.withColumn("raster", META.raster()).collect()
    want = {(math.floor((p.x + 2) / 0.5), math.floor((p.y + 1) / 0.25), math.floor(p.z / 0.5)) for p in cloud(spark).collect() if -2 <= p.x < 2 and -1 <= p.y < 2 and 0 <= p.z < 2}
    assert {(r.gx, r.gy, r.gz) for r in rows} == want
    assert voxel.broken(made, META).count() == 0
    back = made.select(META.raster().alias("r"), "gx", "gy", "gz").withColumns({f"_{k}": c for k, c in META.from_raster(F.col("r")).items()})
    assert back.where("gx <> _gx or gy <> _gy or gz <> _gz").count() == 0
    assert made.where("abs(first_update - 1.5) > 1e-10 or hits < 1").count() == 0


def test_merge_unites_keys_and_blends(spark):
    a, b = (voxel.voxelize(cloud(spark, seed=s), META, ["f"], F.lit(float(s)), "avg") for s in (1, 2))
    merged = {(r.gx, r.gy, r.gz): r for r in voxel.merge(a, b, ["f"], 0.25).collect()}
    left, right = ({(r.gx, r.gy, r.gz): r for r in df.collect()} for df in (a, b))
    assert merged.keys() == left.keys() | right.keys()
    for k, r in merged.items():
        values = [side[k].f if k in side else None for side in (left, right)]
        want = 0.75 * values[0] + 0.25 * values[1] if None not in values else values[1] if values[1] is not None else values[0]
        assert (r.f is None and want is None) or abs(r.f - want) < 1e-9


def test_grid_values():
    assert META.n == (8, 12, 4) and META.intersects(META) and META.close_to(META)
    assert GridMeta((0.0,), (1.0,), (0.5,)).moved((0.75,), (0.0,)).origin == (1.0,)  # half to even: 1.5 -> 2
    assert GridMeta((0.0,), (1.0,), (0.5,)).moved((0.75,), (0.0,), "floor").origin == (0.5,)
    keys = FeatureKeys.expand([{"key": "a", "n": 2}, "b"], "vfm")
    assert keys.label == ("a_0", "a_1", "b") and FeatureKeys.loads(keys.dumps()) == keys and keys.prefixed("a") == [0, 1]


def plane(spark, a, b, n=9):
    return spark.createDataFrame([(i, j, a * i + b * j, 1.0) for i in range(n) for j in range(n)], "i long, j long, z double, m double")


@pytest.mark.parametrize("kind", ["sobel", "scharr"])
def test_slope_of_a_plane(spark, kind):
    got = stencil.slope(plane(spark, 0.5, -0.25), "z", "m", kind, 1.0, 1.0).where("i between 1 and 7 and j between 1 and 7")
    scale = {"scharr": 1.0, "sobel": sum(abs(w) * abs(i) for i, j, w in kernel("sobel_x", 1.0, 1.0))}[kind]
    assert got.where(f"abs(slope_x - {0.5 * scale}) > 1e-6 or abs(slope_y + {0.25 * scale}) > 1e-6").count() == 0
    assert got.count() == 49


def test_stencil_against_numpy(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(12, 10))
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(12) for j in range(10)], "i long, j long, z double")
    taps = kernel("gaussian", 2.0, 1.0, 2.0)
    got = {(r.i, r.j): r.s for r in stencil.scatter(cells, taps, {"s": F.col("z")}).collect()}
    for i in range(12):
        for j in range(10):
            want = sum(w * z[i + a, j + b] for a, b, w in taps if 0 <= i + a < 12 and 0 <= j + b < 10)
            assert abs(got[i, j] - want) < 1e-9


def test_signed_distance_against_brute_force(spark):
    inside = {(i, j) for i in range(12) for j in range(12) if (i - 5) ** 2 + (j - 6) ** 2 <= 9}
    cells = spark.createDataFrame([(i, j, float((i, j) in inside)) for i in range(12) for j in range(12)], "i long, j long, m double")
    for r in stencil.signed_distance(cells, F.col("m") > 0, 0.5).collect():
        other = [c for c in ((i, j) for i in range(12) for j in range(12)) if (c in inside) != ((r.i, r.j) in inside)]
        want = min(math.hypot(r.i - a, r.j - b) for a, b in other) * 0.5 * (-1 if (r.i, r.j) in inside else 1)
        assert abs(r.sdf - want) < 1e-9


def test_distance_to_the_nearest_of_all_poses(spark):
    rng = np.random.default_rng(21)
    cells = spark.createDataFrame([(i, j) for i in range(-20, 30, 3) for j in range(-30, 20, 3)], "i long, j long")
    for xy in (rng.normal(scale=8.0, size=(300, 2)), rng.normal(loc=200.0, scale=30.0, size=(60, 2)), np.array([[7.25, -900.5]])):
        poses = spark.createDataFrame([(float(a), float(b)) for a, b in xy] * 2 + [(None, 0.0)], "px double, py double")
        got = {(r.i, r.j): r.distance for r in stencil.nearest_distance(cells, poses, F.col("i") + 0.5, F.col("j") + 0.5, 4.0).collect()}
        assert len(got) == cells.count()
        assert all(abs(v - np.hypot(*(xy - (i + 0.5, j + 0.5)).T).min()) < 1e-9 for (i, j), v in got.items())
    none = stencil.nearest_distance(cells, poses.where("false"), F.col("i") + 0.5, F.col("j") + 0.5, 4.0)
    assert none.count() == cells.count() == none.where("distance is null").count()


def test_wall_scene_misses(spark):
    wall = spark.createDataFrame([(10.0, float(y) / 4, 0.0) for y in range(-8, 9)], "x double, y double, z double")
    voxels = spark.createDataFrame([(5, 0, 0, 0.0, 5.0, 0.01, 0.01), (15, 0, 0, 0.0, 15.0, 0.01, 0.01)], "gx long, gy long, gz long, misses double, cx double, cy double, cz double")
    model = rays.SensorModel((-30.0, 30.0, 12), (-180.0, 180.0, 72))
    got = {r.gx: r.misses for r in rays.raytrace(voxels, wall, model, (0.0, 0.0, 0.0), {k: F.col(k) for k in ("cx", "cy", "cz")}).collect()}
    assert got[5] == 1.0


def test_covariance_inverse(spark):
    m = np.array([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]])
    row = spark.createDataFrame([(2.0, 0.3, 0.1, 1.0, 0.2, 3.0)], ", ".join(f"c_{k} double" for k in covariance.SIX))
    got = row.select(*covariance.inverse(covariance.of("c"), 0.0)).first()
    want = np.linalg.inv(m)
    assert np.allclose(got, [want[0, 0], want[0, 1], want[0, 2], want[1, 1], want[1, 2], want[2, 2]])


def test_as_of_over_slices(spark):
    rng = np.random.default_rng(5)
    left = [(k, 1, int(t)) for k, t in enumerate(rng.choice(10_000, 60, replace=False))]
    right = [(1, int(t), float(t)) for t in rng.choice(10_000, 25, replace=False)]
    got = temporal.nearest(spark.createDataFrame(left, "id long, run long, t long"), spark.createDataFrame(right, "run long, t long, p double"), "run", ["p"], 700).collect()
    assert len(got) == 60
    for r in got:
        assert r.match_t == min((t for _, t, _ in right), key=lambda t: (abs(t - r.t), t))


def test_last_overlap_reaches_any_frame(spark):
    rng = np.random.default_rng(12)
    runs = {0: [0.0] * 1100 + [9.0], 1: list(rng.normal(scale=0.3, size=400).cumsum()), 2: [0.0] * 70, 3: [5.0], 4: [0.0] * 63 + [9.0] + [0.0] * 40}
    frames = spark.createDataFrame([(k, i, float(p)) for k, ps in runs.items() for i, p in enumerate(ps, 1)], "run long, idx long, p double")
    got = {(r.run, r.idx): r.last_idx for r in temporal.last_overlap_any(frames, "run", 1.0).collect()}
    want = {(k, i): next((j for j in range(i, len(ps)) if abs(ps[i - 1] - ps[j]) > 2), len(ps)) for k, ps in runs.items() for i in range(1, len(ps) + 1)}
    assert got == want and max(j - i for (_, i), j in want.items()) > 1000


@pytest.mark.parametrize("fan", [2, 5, 256])
def test_last_overlap_by_blocks(spark, monkeypatch, fan):
    """Few and many levels, unknown places, keys that are text; runs of one block need no join."""
    monkeypatch.setattr(temporal, "FAN", fan)
    rng = np.random.default_rng(fan)
    runs = {"a": rng.normal(scale=0.4, size=90).cumsum().tolist(), "b": [0.0] * 41, "c": [0.0, None, 0.0], "d": [3.0]}
    frames = spark.createDataFrame([(k, i, p) for k, ps in runs.items() for i, p in enumerate(ps, 1)], "run string, idx long, p double")
    made = temporal.last_overlap_any(frames, "run", 1.0)
    got = {(r.run, r.idx): r.last_idx for r in made.collect()}
    fails = lambda a, b: a is None or b is None or abs(a - b) > 2
    assert got == {(k, i): next((j for j in range(i, len(ps)) if fails(ps[i - 1], ps[j])), len(ps)) if ps[i - 1] is not None else i - 1 for k, ps in runs.items() for i in range(1, len(ps) + 1)}
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ("Join" in plan) == (fan < 90) and (fan < 90 or plan.count("Exchange ") == 1)


def test_terrain_plan_fails_early(spark):
    with pytest.raises(ValueError, match="needs layers"):
        terrain.run([{"type": "slope", "input_layer": "z", "mask_layer": "m", "radius": 1.0}], cloud(spark), 1.0)
    with pytest.raises(ValueError, match="unknown block"):
        terrain.run([{"type": "nothing"}], cloud(spark), 1.0)


def test_stream_equals_fold_and_survives_replay(spark, tmp_path):
    state = VoxelMap(spark, str(tmp_path / "map"), META, ["f"], 0.5, cull_share=None)
    scans = [cloud(spark, 200, s).withColumn("stamp", F.lit(float(s))) for s in (1, 2, 3)]
    for k, scan in enumerate(scans):
        state.update(scan, k)
    state.update(scans[2], 2)  # a replayed batch changes nothing
    per_scan = None
    for s, scan in enumerate(scans):
        one = voxel.voxelize(scan, META, ["f"], F.col("stamp"), "avg").withColumn("s", F.lit(s))
        per_scan = one if per_scan is None else per_scan.unionByName(one)
    want = {(r.gx, r.gy, r.gz): r.f for r in voxel.fold(per_scan.where("f is not null"), ["f"], 0.5, "s").collect()}
    got = {(r.gx, r.gy, r.gz): r.f for r in state.state().collect() if r.f is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_columns_of_two_surfaces(spark):
    points = [(x + 0.5, y + 0.5, s * (1.1 + 0.1 * x)) for x in range(5) for y in range(5) for s in (-1, 1)]
    vox = spark.createDataFrame([(int(x), int(y), k, z) for k, (x, y, z) in enumerate(points)], "gx long, gy long, gz long, z double")
    for r in columns.elevation_stats(vox, F.col("z")).collect():
        assert r.num_voxels == 2 and abs(r.max_elevation + r.min_elevation) < 1e-8


def _rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v != v else float(v) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name not in registry.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "part"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [[float(v) if isinstance(v, (int, np.integer, float)) and not isinstance(v, bool) else v for v in r] for r in _rows(got)] == [[float(v) if isinstance(v, (int, np.integer, float)) and not isinstance(v, bool) else v for v in r] for r in _rows(want)]


def test_elevation_merge_forgets_an_overhang_only(spark):
    grid = lambda rows: spark.createDataFrame(rows, "gx long, gy long, min_elevation double, max_elevation double, hits long")
    old = grid([(0, 0, 0.0, 1.5, 1), (0, 1, 0.0, 9.0, 1), (0, 2, 0.0, 9.0, 1), (0, 3, 0.0, 9.0, 1), (0, 5, 5.0, 10.0, 1)])
    new = grid([(0, 0, 0.0, 1.0, 2), (0, 1, 0.0, 1.0, 2), (0, 2, 0.0, 7.0, 2), (0, 4, 2.0, 3.0, 2), (0, 5, 1.0, 2.0, 2)])
    got = {r.gy: (r.min_elevation, r.max_elevation, r.hits) for r in columns.merge_elevation(old, new, 6.0).collect()}
    assert got == {0: (0.0, 1.5, 3), 1: (0.0, 1.0, 3), 2: (0.0, 9.0, 3), 3: (0.0, 9.0, 1), 4: (2.0, 3.0, 2), 5: (1.0, 2.0, 3)}


def test_moving_map_keeps_its_voxels(spark, tmp_path):
    meta = GridMeta((0.0, 0.0, 0.0), (4.0, 4.0, 4.0), (1.0, 1.0, 1.0))
    state = VoxelMap(spark, str(tmp_path / "map"), meta, ["f"], 0.5, cull_share=None)
    points = lambda *xs: spark.createDataFrame([(x, 2.5, 2.5, 1.0, 0.0) for x in xs], "x double, y double, z double, f double, stamp double")
    state.update(points(0.5, 2.5), 0)
    state.meta = meta.moved((1.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    state.update(points(2.5, 4.5), 1)
    assert {(r.gx, r.gy, r.gz): r.hits for r in state.state().collect()} == {(1, 2, 2): 2.0, (3, 2, 2): 1.0}


def test_rays_of_a_turned_sensor(spark):
    """A sensor turned by 90 degrees to the left sees straight ahead what lies on the y axis."""
    h = 0.5**0.5
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, 5.0, 0.0)], "x double, y double, z double")
    got = rays.local(df, (1.0, 0.0, 3.0, 0.0, 0.0, h, h), F.col("x"), F.col("y"), F.col("z")).collect()
    assert abs(got[0].az) < 1e-9 and abs(got[0].el) < 1e-9 and abs(got[0].range - 2) < 1e-9
    assert abs(got[1].az - np.arctan2(1, 5)) < 1e-9 and abs(got[1].el - np.arctan2(-3, 26**0.5)) < 1e-9


def test_exact_quantile_by_histograms(spark):
    rng = np.random.default_rng(8)
    for values in (rng.lognormal(sigma=4, size=3000), rng.integers(0, 5, 500).astype(float), np.array([2.5]), np.append(np.zeros(99), 7.0)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert np.isclose(covariance.quantile(rows, F.col("v"), share, 8), np.quantile(values, share), rtol=1e-12)
    assert covariance.quantile(rows.where("false"), F.col("v"), 0.5) is None


def test_runs_over_many_blocks_and_slices(spark, monkeypatch):
    """Numbers, gaps, streaks, means, strides and bands of runs that blocks and slices cut, against lists; with a null key."""
    monkeypatch.setattr(temporal, "RUN_BLOCK", 4)
    rng = np.random.default_rng(14)
    runs = {k: sorted(int(t) for t in rng.choice(3000, n, replace=False)) for k, n in ((1, 90), (2, 3), (3, 1), (None, 17))}
    runs = {k: [(t, float(rng.integers(0, 4))) for t in ts] for k, ts in runs.items()}
    rows = spark.createDataFrame([(k, t, p) for k, ts in runs.items() for t, p in ts], "run long, t long, p double").repartition(5)
    by = lambda df, *cs: {(r.run, r.t): tuple(r[c] for c in cs) if len(cs) > 1 else r[cs[0]] for r in df.collect()}
    each = [(k, i, ts) for k, ts in runs.items() for i in range(len(ts))]
    assert by(temporal.numbered(rows, "run", "n", 100), "n") == {(k, ts[i][0]): i + 1 for k, i, ts in each}
    assert by(temporal.without_repeats(rows, "run", 20, 100), "t").keys() == {(k, ts[i][0]) for k, i, ts in each if i == 0 or ts[i][0] - ts[i - 1][0] > 20}
    assert by(temporal.strided(rows, "run", 2, 5, 100), "t").keys() == {(k, ts[i][0]) for k, i, ts in each if i % 5 == 1}
    for n in (3, 7):
        got = by(temporal.trailing(rows, "run", "p", n, 100), "context_mean", "first_value")
        for k, i, ts in each:
            mean, first = got[k, ts[i][0]]
            assert first == ts[0][1] and (mean is None if i == 0 else abs(mean - np.mean([p for _, p in ts[max(0, i - n) : i]])) < 1e-9)
    for longest in (1, 2, 6):
        whole = lambda ts, i: i + 1 >= longest and all(p > 1 for _, p in ts[i + 1 - longest : i + 1])  # noqa: B023, E731
        assert by(temporal.before_run(rows, "run", F.col("p") > 1, longest, 100), "t").keys() == {(k, ts[i][0]) for k, i, ts in each if not any(whole(ts, j) for j in range(i + 1))}
    known = {k: ts for k, ts in runs.items() if k is not None}
    got = by(temporal.band_counts(rows.where("run is not null"), "run", 150, 70, "n", 100), "n")
    assert got == {(k, t): sum(t - 150 <= u <= t + 70 for u, _ in ts) for k, ts in known.items() for t, _ in ts}


def test_footprint_ends_where_it_is_hidden(spark):
    """A vehicle drives ahead along x; a wall beside the way hides nothing, one across it hides what lies behind."""
    fields = "run long, t long, px double, py double, pz double, qx double, qy double, qz double, qw double"
    path = spark.createDataFrame([(1, k * 100_000, 0.5 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(60)], fields)
    images = path.where("t = 0").withColumn("image", F.lit(7).cast("long"))
    plan = poses.footprint(0.4, 0.4, 2, 2, -1.0)
    model = rays.SensorModel((-45.0, 45.0, 90), (-45.0, 45.0, 90))
    camera = {"cam": 0, "width": 100, "height": 100, "p": [[50.0, -50.0, 0.0, 0.0], [50.0, 0.0, -50.0, 0.0], [1.0, 0.0, 0.0, 0.0]]}
    wall = lambda x: spark.createDataFrame([(7, x, 0.05 * a, 0.05 * b) for a in range(-60, 61) for b in range(-60, 1)], "image long, x double, y double, z double")
    pixel = lambda x, y: (math.floor(50 - 50 * y / x), math.floor(50 + 50 / x))
    made = {x: {(r.u, r.v) for r in poses.footprint_pixels(images, path, wall(x), plan, model, camera, "run", "image", slack=0.5, longest=3, steps=80).collect()} for x in (5.0, 90.0)}
    # In view are points at most 45 degrees down and aside, and at the camera only what lies ahead of it.
    ahead = lambda far: {pixel(0.5 * k + dx, dy) for k in range(60) for dx in (-0.2, 0.2) for dy in (-0.2, 0.2) if 1.0 < 0.5 * k + dx < far and 0 <= pixel(0.5 * k + dx, dy)[0] < 100 and 0 <= pixel(0.5 * k + dx, dy)[1] < 100}
    assert made[90.0] == ahead(100.0)
    assert ahead(5.0) <= made[5.0] <= ahead(6.0)
    assert {(u, v) for u, v in made[90.0] if v < 60} == {(r.u, r.v) for r in poses.footprint_pixels(images, path, wall(90.0), plan, model, camera, "run", "image", longest=3, steps=80, rows_below=60.0).collect()}


def test_footprints_share_a_cloud_without_copies(spark):
    """Images of one place see one cloud: the same pixels as with a copy for each, and no shuffle of returns before they are bins."""
    turn = {c: F.lit(v) for c, v in zip(poses.TURN, (0.0, 0.0, 0.0, 1.0), strict=True)}
    path = spark.range(60).select(F.lit(1).alias("run"), (F.col("id") * 100_000).alias("t"), (F.col("id") * 0.5).alias("px"), F.lit(0.0).alias("py"), F.lit(1.0).alias("pz")).withColumns(turn)
    images = path.where("t in (0, 500000, 900000)").withColumns({"image": F.col("t"), "place": F.when(F.col("t") == 0, 3).otherwise(4)})
    clouds = spark.createDataFrame([(k, 5.0 * k, 0.1 * a, 0.1 * b) for k in (3, 4) for a in range(-30, 31) for b in range(-30, 1)], "place int, x double, y double, z double")
    model = rays.SensorModel((-45.0, 45.0, 90), (-45.0, 45.0, 90))
    camera = {"cam": 0, "width": 100, "height": 100, "p": [[50.0, -50.0, 0.0, 0.0], [50.0, 0.0, -50.0, 0.0], [1.0, 0.0, 0.0, 0.0]]}
    ask = lambda cloud, **more: poses.footprint_pixels(images, path, cloud, poses.footprint(0.4, 0.4, 2, 2, -1.0), model, camera, "run", "image", slack=0.5, longest=3, steps=50, **more)
    shared = ask(F.broadcast(clouds), on="place")
    copies = ask(clouds.join(images.select("image", "place"), "place").drop("place"))
    got = sorted(map(tuple, shared.collect()))
    assert got == sorted(map(tuple, copies.collect())) and len({r[0] for r in got}) == 3
    before = shared._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert sum("Exchange" in line for line in before) == 1  # the deal of the images; returns meet the broadcast cloud after it
