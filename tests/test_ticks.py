"""Maps that follow a vehicle: streams of ticks, also after a restart, against batch operators applied tick by tick."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.grid import KEYS, GridMeta
from terravox.operators import columns, rays, voxel
from terravox.streaming import ticks

MODEL = rays.SensorModel((-60.0, 60.0, 24), (-180.0, 180.0, 72))
BASE = GridMeta((-6.0, -5.0, -3.0), (12.0, 10.0, 6.0), (1.0, 1.0, 0.5))
POSES = [(r, t, float(t), x + 40.0 * r, y, 2.2) for r in (0, 1) for t, x, y in ((1, 0.3, 0.2), (2, 1.7, 0.9), (3, 3.4, 1.3), (4, 3.1, 4.4), (5, 44.7, 4.1), (6, 45.9, 5.2), (7, 4.2, 4.9))]
POSE, POINT = "run long, tick long, stamp double, px double, py double, pz double", "run long, tick long, x double, y double, z double, f0 double, f1 double"


def scene(spark, n=250):
    """Points around each pose, some without features, some at equal distance, and one tick without any."""
    rng = np.random.default_rng(7)
    rows = []
    for run, tick, _, px, py, pz in POSES:
        if tick == 6:
            continue
        for k in range(n):
            x, y, z = rng.uniform((-8, -7, -3.5), (8, 7, 3.5)) + (px, py, pz)
            f = (None, None) if k % 3 == 0 else (float(rng.uniform()), float(rng.uniform()))
            rows.append((run, tick, float(x), float(y), float(z), *f))
        rows += [(run, tick, px + 1.4, py, pz, 0.25, 0.5), (run, tick, px + 1.4, py, pz, 0.75, 0.5)]
    return spark.createDataFrame(rows, POINT), spark.createDataFrame(POSES, POSE)



@pytest.fixture(scope="module")
def expected(spark):
    """Cells after ticks 3, 5 and 7: move, raytrace, merge and cull by the batch operators, one tick after the other."""
    points, out = scene(spark)[0].cache(), {3: {}, 5: {}, 7: {}}
    for run in (0, 1):
        state, old = None, None
        for _, tick, stamp, *pose in [p for p in POSES if p[0] == run]:
            meta = BASE.moved(tuple(pose), BASE.origin)
            scan = points.where((F.col("run") == run) & (F.col("tick") == tick))
            new = voxel.voxelize(scan, meta, ["f0", "f1"], F.lit(stamp), "mindist", tuple(pose))
            if state is not None:
                state = rays.raytrace(voxel.crop(state, old, meta), scan, MODEL, tuple(pose), meta.centres())
                new = voxel.merge(state, new, ["f0", "f1"], 0.5)
            rows = voxel.cull(new).select(*KEYS, "hits", "misses", *(f"{e}_{a}" for e in ("min", "max") for a in "xyz"), "first_update", "last_update", "f0", "f1")
            state, old = spark.createDataFrame(rows.collect(), rows.schema).coalesce(1), meta
            if tick in out:
                shift = [round(o / r) for o, r in zip(old.origin, old.resolution, strict=True)]
                for r in state.collect():
                    out[tick][(run, *(r[k] + s for k, s in zip(KEYS, shift, strict=True)))] = tuple(r[3:])
    return out


def rows_of(df, names):
    got = {(r.run, *(r[k] for k in KEYS if k in df.columns)): tuple(r[n] for n in names) for r in df.collect()}
    assert len(got) == df.count()
    return got


def same(got, want):
    assert set(got) == set(want), (len(got), len(want), sorted(set(got) ^ set(want))[:5])
    for k, w in want.items():
        for a, b in zip(got[k], w, strict=True):
            none = lambda v: v is None or v != v
            assert (none(a) and none(b)) or abs(a - b) < 1e-9, (k, got[k], w)


MAP = ticks.VoxelTicks(BASE, ("f0", "f1"), 0.5, 4, MODEL)


def test_tables_fold_as_the_operators_do(spark, expected):
    points, poses = scene(spark)
    same(rows_of(MAP.fold(MAP.table_messages(points, poses)), MAP.layers), expected[7])
    same(rows_of(MAP.fold(MAP.messages(ticks.scans_of(points, poses, ["f0", "f1"]))), MAP.layers), expected[7])


def test_without_rays_and_culling_nothing_is_missed(spark):
    points, poses = scene(spark)
    plain = ticks.VoxelTicks(BASE, ("f0", "f1"), 0.5, 4, None, cull_share=None)
    got = rows_of(plain.fold(plain.table_messages(points, poses)), plain.layers)
    same(rows_of(plain.fold(plain.messages(ticks.scans_of(points, poses, ["f0", "f1"]))), plain.layers), got)
    assert got and all(v[1] == 0 and v[0] >= 1 and v[2] <= v[5] and v[8] <= v[9] for v in got.values())


@pytest.fixture()
def state_store(spark):
    for k, v in ticks.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in ticks.STATE_STORE:
        spark.conf.unset(k)


def play(stream, scans, folder, tmp, ticks_of):
    """Ticks as files, and the stream over what is there, from its checkpoint."""
    for t in ticks_of:
        scans.where(F.col("tick") == t).coalesce(1).write.mode("append").parquet(f"{tmp}/{folder}")
    source = stream.spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/{folder}")
    stream.start(source, f"{tmp}/{folder}-checkpoint", availableNow=True).awaitTermination()


def test_stream_of_ticks_and_a_restart(spark, state_store, expected, tmp_path):
    points, poses = scene(spark)
    scans = ticks.scans_of(points, poses, ["f0", "f1"])
    scans = spark.createDataFrame(scans.collect(), scans.schema)
    stream = ticks.TickStream(spark, f"{tmp_path}/map", MAP)
    play(stream, scans, "scans", tmp_path, (1, 2, 3))
    same(rows_of(stream.cells(), MAP.layers), expected[3])
    # A new stream over the same checkpoint goes on with the tiles it had; a repeated tick counts once.
    again = ticks.TickStream(spark, f"{tmp_path}/map", MAP)
    play(again, scans, "scans", tmp_path, (3, 4, 5))
    same(rows_of(again.cells(), MAP.layers), expected[5])
    play(again, scans, "scans", tmp_path, (6, 7))
    same(rows_of(again.cells(), MAP.layers), expected[7])


def test_a_batch_writes_the_tiles_it_changes(spark, state_store, tmp_path):
    """Far tiles keep their files while the vehicle works elsewhere."""
    near = [(0, t, 1.0 * t, 0.2, 0.1, 0.0) for t in (1, 2)] + [(1, t, 1.0 * t, 0.2, 0.1, 0.0) for t in (1,)]
    points = [(r, t, 0.5 + k, 0.5, 0.2, 1.0, 1.0) for r, t, *_ in near for k in ((-5, 4) if t == 1 else (4,))]
    scans = ticks.scans_of(spark.createDataFrame(points, POINT), spark.createDataFrame(near, POSE), ["f0", "f1"])
    scans = spark.createDataFrame(scans.collect(), scans.schema)
    stream = ticks.TickStream(spark, f"{tmp_path}/map", ticks.VoxelTicks(BASE, ("f0", "f1"), 0.5, 4, None))
    play(stream, scans, "scans", tmp_path, (1,))
    before = {p.parent: p.name for p in (tmp_path / "map").rglob("*.parquet")}
    play(stream, scans, "scans", tmp_path, (2,))
    after = {p.parent: p.name for p in (tmp_path / "map").rglob("*.parquet")}
    assert set(before) == set(after) and [p.relative_to(tmp_path / "map").as_posix() for p in sorted(after) if after[p] != before[p]] == ["run=0/tx=-2/ty=-2", "run=0/tx=1/ty=0"]


def test_timer_forgets_tiles_that_no_tick_reaches(spark, state_store, tmp_path):
    """The vehicle jumps: tiles far behind it get no message and go by their timer."""
    poses = [(0, 1, 1.0, 0.0, 0.0, 0.0), (0, 2, 2.0, 500.0, 0.0, 0.0), (0, 3, 60.0, 500.0, 0.0, 0.0), (0, 4, 61.0, 500.0, 0.0, 0.0)]
    points = [(0, t, px + 0.5, 0.5, 0.2, 1.0, 1.0) for _, t, _, px, *_ in poses]
    scans = ticks.scans_of(spark.createDataFrame(points, POINT), spark.createDataFrame(poses, POSE), ["f0", "f1"])
    scans = spark.createDataFrame(scans.collect(), scans.schema)
    stream = ticks.TickStream(spark, f"{tmp_path}/map", ticks.VoxelTicks(BASE, ("f0", "f1"), 0.5, 4, None), forget=10.0)
    play(stream, scans, "scans", tmp_path, (1, 2))
    kept = lambda: sorted(r.gx for r in spark.read.parquet(f"{tmp_path}/map").where("gx is not null").collect())
    assert [r.gx for r in stream.cells().collect()] == [500] and kept() == [0, 500]
    play(stream, scans, "scans", tmp_path, (3, 4))
    assert kept() == [500]
    assert sorted((r.gx, r.hits) for r in stream.cells().collect()) == [(500, 3.0)]


def test_bev_stream_follows_the_operators(spark, state_store, tmp_path):
    points, poses = scene(spark, 300)
    base = GridMeta((-6.0, -5.0, 0.0), (12.0, 10.0, 1.0), (1.0, 1.0, 1.0))
    bev = ticks.BevTicks(base, ("f0", "f1"), 0.5, 4, overhang=1.5)
    scans = ticks.scans_of(points, poses, ["f0", "f1"])
    scans = spark.createDataFrame(scans.collect(), scans.schema)
    stream = ticks.TickStream(spark, f"{tmp_path}/bev", bev)
    play(stream, scans, "scans", tmp_path, (1, 2, 3))
    play(stream, scans, "scans", tmp_path, (4,))
    want = {}
    for run in (0, 1):
        heights = features = old = None
        for _, tick, _, *pose in [p for p in POSES if p[0] == run and p[1] <= 4]:
            meta = base.moved((pose[0], pose[1], 0.0), base.origin, "floor")
            scan = points.where((F.col("run") == run) & (F.col("tick") == tick))
            if heights is not None:
                by = [round((a - b) / r) for a, b, r in zip(meta.origin[:2], old.origin[:2], meta.resolution[:2], strict=True)]
                heights, features = (g.withColumns({"gx": F.col("gx") - by[0], "gy": F.col("gy") - by[1]}).where("gx between 0 and 11 and gy between 0 and 9") for g in (heights, features))
                scan = columns.below_overhang(scan, heights, meta, 1.5)
            h, f = columns.elevation_grid(scan, meta), columns.bev_from_points(scan, meta, ["f0", "f1"])
            if heights is not None:
                h, f = columns.merge_elevation(heights, h, 1.5), columns.merge_features(features, f, ["f0", "f1"], 0.5)
            heights, features, old = spark.createDataFrame(h.collect(), h.schema), spark.createDataFrame(f.collect(), f.schema), meta
        shift = [round(o / r) for o, r in zip(old.origin, old.resolution, strict=True)]
        both = {(r.gx, r.gy): [r.min_elevation, r.max_elevation, r.hits, 0, None, None] for r in heights.collect()}
        for r in features.collect():
            both[r.gx, r.gy][3:] = [r.hits, r.f0, r.f1]
        want |= {(run, i + shift[0], j + shift[1]): tuple(v) for (i, j), v in both.items()}
    same(rows_of(stream.cells(), bev.layers), want)


def test_numpy_bins_are_the_columns_bins(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(0, 5, (4000, 3))
    for model in (MODEL, rays.SensorModel.named("vlp32c_front"), rays.SensorModel.named("vlp32c"), rays.SensorModel((-30.0, 30.0, 6), (-180.0, 180.0, 12), 5.0, 20.0)):
        at, r = rays.bins_of(model, xyz)
        df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "k long, x double, y double, z double")
        got = rays.local(df, (0.0, 0.0, 0.0), F.col("x"), F.col("y"), F.col("z")).withColumn("bin", model.bin(F.col("el"), F.col("az"))).collect()
        assert all((-1 if g.bin is None else g.bin) == at[g.k] and abs(g.range - r[g.k]) < 1e-9 for g in got)
