"""Files written and read again, and streams that stop and go on, against the same work in batch."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.grid import GridMeta
from terravox.operators import covariance, labels, voxel
from terravox.sources import files, frames, generated, models
from terravox.streaming import mapper


def png(pixels):
    """An RGB image file of an array (height, width, 3)."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_arrays_and_numbers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    arrays = {7: np.arange(6.0).reshape(2, 3), 8: np.array([1, 2], dtype=np.int32), 9: np.zeros((0, 3))}
    for k, a in arrays.items():
        np.save(tmp_path / "deep" / f"{k:08d}.npy", a)
    got = {r.frame_id: r for r in files.npy_frames(spark, str(tmp_path)).collect()}
    assert got.keys() == arrays.keys()
    assert all(got[k].shape == list(a.shape) and got[k]["values"] == a.ravel().tolist() for k, a in arrays.items())
    (tmp_path / "poses.txt").write_text("1.5  2 -3e2\n\n 4 x 6 \n")
    assert [r["values"] for r in files.number_lines(spark, str(tmp_path / "poses.txt")).collect()] == [[1.5, 2.0, -300.0], [4.0, None, 6.0]]


def test_images_and_what_is_none(spark, tmp_path):
    pixels = np.random.default_rng(4).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = files.image_pixels(spark, str(tmp_path)).collect()
    seen = {(r.v, r.u): (r.r, r.g, r.b) for r in rows if r.v is not None}
    assert len(rows) == 16 and len(seen) == 15
    assert all(np.allclose(np.array(c) * 255, pixels[v, u]) for (v, u), c in seen.items())
    assert files.image_pixels(spark, str(tmp_path), drop_invalid=True).count() == 15


def test_packed_points_and_frames(spark, tmp_path):
    raw = struct.pack("<fffIfffI", 1, 2, 3, 0xFF8000, 0, 0, 0, 5)
    df = spark.createDataFrame([(1, raw), (2, b"")], "frame_id long, content binary")
    points = files.packed_points(df, colour=True)
    assert [tuple(r) for r in files.valid_points(points).collect()] == [(1, 1.0, 2.0, 3.0, 0xFF8000)]
    files.write_frames(points, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).where("frame_id = 1").count() == 2
    rows = files.ontology(spark, {"2": {"label": "tree", "color": [1, 2, 3]}, "10": {"label": "rock", "prompt": "stone", "color": [0, 0, 0]}}).collect()
    assert [(r.id, r.prompt) for r in rows] == [(2, "tree"), (10, "stone")]


META = GridMeta((0.0, 0.0, 0.0), (4.0, 4.0, 4.0), (1.0, 1.0, 1.0))


def test_stream_of_files_goes_on_after_a_stop(spark, tmp_path):
    source, schema = tmp_path / "in", "x double, y double, z double, f double, stamp double"
    source.mkdir()

    def put(n):
        rng = np.random.default_rng(n)
        rows = [(*map(float, rng.uniform(0, 4, 3)), float(rng.integers(0, 9)), float(n)) for _ in range(120)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"s{n}"))

    state = mapper.VoxelMap(spark, str(tmp_path / "map"), META, ["f"], 0.5, cull_share=None)
    for n in (0, 1):
        put(n)
        points = spark.readStream.schema(schema).parquet(str(source / "*"))
        # Each start is a new query over the same checkpoint, as after a failure.
        state.start(points, str(tmp_path / "check"), availableNow=True).awaitTermination()
    scans = spark.read.parquet(str(source / "*"))
    made = voxel.voxelize(scans, META, ["f"], F.col("stamp"), "avg", per=("stamp",))
    want = {(r.gx, r.gy, r.gz): (r.hits, r.f, r.first_update, r.last_update) for r in voxel.merge_all(made, ["f"], 0.5, "stamp").collect()}
    got = {(r.gx, r.gy, r.gz): (r.hits, r.f, r.first_update, r.last_update) for r in state.state().collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_windows_and_latest_messages_of_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k % 7:02d}:00", k % 3, float(k)) for k in range(60)]
    batch = spark.createDataFrame(rows, "id long, s string, run long, p double").select("id", F.to_timestamp("s").alias("ts"), "run", "p")
    batch.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = {(r.window.start, r.run): (r.n, r["mean"]) for r in run(mapper.windowed(stream(), "ts", "run", "p", "1 minute"), "counts", "complete")}
    want = {(r.m, r.run): (r.n, r.p) for r in batch.groupBy(F.date_trunc("minute", "ts").alias("m"), "run").agg(F.count("*").alias("n"), F.avg("p").alias("p")).collect()}
    assert got == want
    last = {r.run: r.id for r in run(mapper.latest_messages(stream(), "run", "id", ["p"]), "last", "complete")}
    assert last == {0: 57, 1: 58, 2: 59}
    once = run(mapper.without_repeats(stream(), ["run", "ts"], "ts", "1 hour"), "once", "append")
    assert len(once) == batch.select("run", "ts").distinct().count()
    pairs = run(mapper.ready(stream().where("run = 0"), stream().where("run = 0"), "run", "30 seconds"), "pairs", "append")
    assert len(pairs) == batch.where("run = 0").alias("a").join(batch.where("run = 0").alias("b"), F.expr("a.ts = b.ts")).count()


def test_frame_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "lidar", f, float(k)) for f in range(4) for k in range(5)], "run string, topic string, frame long, x double")
    about = rows.groupBy("run", "topic", "frame").agg(F.count("*").alias("n"), F.lit(0.5).alias("resolution"))
    frames.save(rows, about, path)
    frames.save(rows.withColumn("run", F.lit("b")).where("frame = 1"), about.withColumn("run", F.lit("b")).where("frame = 1"), path)
    assert frames.load(spark, path).count() == 25 and frames.load(spark, path, "a", first=1, last=2).count() == 10
    assert {(r.run, r.frame, r.n) for r in frames.about(spark, path, topic="lidar").collect()} == {("a", f, 5) for f in range(4)} | {("b", 1, 5)}
    assert len(frames.load(spark, path, "b").inputFiles()) >= 1 and frames.load(spark, path, "none").count() == 0
    assert [r.item for r in frames.repeated(rows.limit(1), 3).orderBy("item").collect()] == [0, 1, 2] and frames.repeated(rows, 0).count() == 0


def test_models_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(5, 3)))[0]
    models.save_pca(spark, str(tmp_path / "pca"), [1.0, 2.0, 3.0, 4.0, 5.0], basis, [0.5, 0.3, 0.1])
    mean, got, share = models.load_pca(spark, str(tmp_path / "pca"))
    assert mean == [1.0, 2.0, 3.0, 4.0, 5.0] and np.array_equal(got, basis) and share.tolist() == [0.5, 0.3, 0.1]
    assert np.array_equal(models.load_pca(spark, str(tmp_path / "pca"), 2)[1], basis[:, :2])
    models.save_centres(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "label long, c array<double>"), str(tmp_path / "centres"))
    assert models.load_centres(spark, str(tmp_path / "centres"), 2).count() == 2
    with pytest.raises(ValueError, match="have not 3"):
        models.load_centres(spark, str(tmp_path / "centres"), 3)


def test_generated_grids(spark):
    for seed in range(4):
        grid = generated.meta(3, seed)
        made = generated.voxels(spark, grid, 2, seed)
        rows = made.collect()
        cells = int(np.prod(grid.n))
        assert len(rows) == len({(r.gx, r.gy, r.gz) for r in rows}) == cells // 2 and made.where(~grid.contains_keys()).count() == 0
        assert sum(r.rand_0 is not None for r in rows) == cells // 4 and all(r.last_update >= r.first_update for r in rows)
        assert sorted(rows) == sorted(generated.voxels(spark, grid, 2, seed).repartition(3).collect())
    plane = generated.bev(spark, GridMeta((0.0, 0.0), (60.0, 50.0), (1.0, 1.0)), 1, 5).toPandas()
    assert len(plane) == 3000 and abs(plane.rand_0.mean()) < 0.1 and abs(plane.rand_0.std() - 1) < 0.1 and plane.hits.between(0, 9).all()


def test_mappers_by_name_and_clearing(spark, tmp_path):
    assert mapper.MAPPERS.keys() == {"voxel", "voxel_covariance"}
    cov = ", ".join(f"cov_{k} double" for k in covariance.SIX)
    scan = lambda dx: spark.createDataFrame([(0.5 + dx, 1.5, 2.5, 2.0 + dx, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (3.5, 1.5, 2.5, 4.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0)], f"x double, y double, z double, f double, {cov}")
    state = mapper.MAPPERS["voxel_covariance"](spark, str(tmp_path / "cov"), META, ["f"], 0.5)
    for k, dx in enumerate((0.0, 0.25)):
        state.update(scan(dx), k)
    got = {(r.gx, r.gy, r.gz): r for r in state.state().collect()}
    assert got.keys() == {(0, 1, 2), (3, 1, 2)} and abs(got[0, 1, 2].center_x - 0.625) < 1e-6 and abs(got[0, 1, 2].f - 2.125) < 1e-4  # the weights hold 1e-6 beside 0.06
    state.clear(2)
    assert state.state().count() == 0
    state.update(scan(0.0), 3)
    assert state.state().count() == 2


def test_stream_of_transforms(spark, tmp_path):
    poses = spark.createDataFrame([(k, float(k), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for k in range(4)], "t long, px double, py double, pz double, qx double, qy double, qz double, qw double")
    poses.write.parquet(str(tmp_path / "in"))
    mapper.transforms(spark.readStream.schema(poses.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tf").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("tf").orderBy("stamp").collect()
    assert [(r.stamp, r.frame_id, r.child_frame_id, r.translation.x, r.rotation.w) for r in rows] == [(k, "odom", "base_link", float(k), 1.0) for k in range(4)]


def test_compressed_masks(spark):
    def compressed(lengths):
        text = ""
        for k, n in enumerate(lengths):
            n -= lengths[k - 2] if k > 2 else 0
            while True:
                digit, n = n & 31, n >> 5
                more = n != (-1 if digit & 16 else 0)
                text += chr(48 + digit + (32 if more else 0))
                if not more:
                    break
        return text

    rng = np.random.default_rng(6)
    masks = [(rng.random((h, w)) < p) for h, w, p in ((7, 5, 0.5), (40, 90, 0.02), (3, 3, 0.0), (4, 2, 1.0))]
    rows = []
    for k, m in enumerate(masks):
        flat = np.r_[False, m.T.ravel(), not m.T.ravel()[-1]]
        cuts = np.flatnonzero(np.diff(flat.astype(int)))
        rows.append((k, compressed(np.diff(np.r_[0, cuts]).tolist()), m.shape[0]))
    for k, text, height in [*rows, (9, None, 3), (10, "", 3)]:
        got = labels.mask_pixels(spark.createDataFrame([(k, text)], "k long, s string").select("k", labels.run_lengths(F.col("s")).alias("n")), ["k"], "n", height).collect()
        want = {(int(u), int(v)) for v, u in np.argwhere(masks[k])} if k < len(masks) else set()
        assert len(got) == len(want) and {(r.u, r.v) for r in got} == want
