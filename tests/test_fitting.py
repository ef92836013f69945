"""Samples, fitted projections and vocabularies, cached results, chains of blocks, recorded runs, and vectors of zeros."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.functions import geometry
from terravox.operators import blocks, columns, covariance, pixels, sampling, vectors
from terravox.sources import cache, files, runs

VECTORS = "id long, label long, v array<double>"


def table(spark, arrays, labels=None):
    return spark.createDataFrame([(k, int(labels[k]) if labels is not None else k % 3, None if a is None else [float(x) for x in a]) for k, a in enumerate(arrays)], VECTORS)


def test_samples_hang_on_no_partitioning(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id % 50 end g", "id k")
    taken = [sorted(map(tuple, sampling.per_group(rows.repartition(n), ["g"], ["k"], 7, 5).collect())) for n in (1, 6)]
    assert taken[0] == taken[1]
    sizes = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    by = {}
    for g, _ in taken[0]:
        by[g] = by.get(g, 0) + 1
    assert by == {g: min(7, n) for g, n in sizes.items()}
    assert sorted(map(tuple, sampling.per_group(rows, ["g"], ["k"], 7, 6).collect())) != taken[0]
    plan = sampling.per_group(rows.repartition(6), ["g"], ["k"], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the shuffle and after it


def test_prompts_and_frame_budget(spark):
    rows = spark.range(400).selectExpr("id div 100 image", "id % 100 d").withColumn("m", F.when(F.col("image") == 0, F.lit(None)).otherwise(F.col("d") < F.col("image") * 10))
    got = {(r.image, r.positive): r["count"] for r in sampling.prompts(rows, "image", ["d"], F.col("m")).groupBy("image", "positive").count().collect()}
    assert got == {(0, False): 5, (1, True): 10, (1, False): 5, (2, True): 20, (2, False): 5, (3, True): 20, (3, False): 5}
    frames = spark.range(100).selectExpr("id % 2 run", "id div 2 idx")
    kept = sorted({r.idx for r in sampling.frame_budget(frames, "run", 20, 2, 10).collect()})
    assert kept == list(range(10, 50, 10))
    assert sampling.frame_budget(frames, "run", 10_000).count() == 100 and sampling.frame_budget(frames.where("false"), "run", 5).count() == 0


def inertia(x, c):
    u, c = x / np.linalg.norm(x, axis=1, keepdims=True), c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return float((1 - (u @ c.T).max(1)).sum())


def test_seeding_is_no_worse_than_random_starts(spark):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(6, 5)) * 4
    x = np.concatenate([h + rng.normal(size=(n, 5)) * 0.2 for h, n in zip(heads, (200, 5, 60, 9, 80, 4), strict=True)])
    rows = table(spark, [*x, np.zeros(5), None])
    centres = vectors.seed_centres(rows, 6, "id", rounds=3)
    assert sorted(map(tuple, (r.c for r in centres.collect()))) == sorted(map(tuple, (r.c for r in vectors.seed_centres(rows.repartition(3), 6, "id", rounds=3).collect())))
    made = vectors.kmeans(rows.where("v is not null"), centres, 8, tol=1e-9)
    assert sum(r.n for r in made.collect()) == len(x) + 1
    best = np.inf
    for _ in range(10):
        c = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(20):
            at = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).argmax(1)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(6)])
        best = min(best, inertia(x, c))
    assert inertia(x, np.array([r.c for r in made.collect()])) <= best * 1.0001


def test_seeding_of_few_and_no_vectors(spark):
    assert vectors.seed_centres(table(spark, [[1, 0], [2, 0], [0, 3]]), 5, "id").count() == 2
    assert vectors.seed_centres(table(spark, [[0, 0]]), 5, "id").count() == 0
    left = vectors.kmeans(table(spark, [[1, 0], [1, 0.1]]), table(spark, [[1, 0], [-1, 0]]).selectExpr("id label", "v c"), 3)
    assert [(r.label, r.n) for r in left.orderBy("label").collect()] == [(0, 2), (1, 0)]


def test_range_finder_gives_the_space_of_the_full_matrix(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64)) @ np.diag(0.8 ** np.arange(64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0] + 3.0
    rows = table(spark, [*x, None, x[0][:10]]).repartition(20)
    mean, basis, share = vectors.fit_pca(rows, 64, 5)
    m, b, s = vectors.range_pca(rows, 64, 5, fan=3)
    assert np.allclose(m, mean) and np.allclose(np.abs((b * basis).sum(0)), 1, atol=1e-6) and np.allclose(s, share, atol=1e-8)
    held = vectors.norms(rows.where("size(v) = 64"), m, b).first()
    c = x - x.mean(0)
    assert abs(held.total - np.linalg.norm(c, axis=1).mean()) < 1e-9 and abs(held.projected - np.linalg.norm(c @ b, axis=1).mean()) < 1e-9
    assert np.allclose(held.cumulative, np.cumsum(np.abs(c @ b).mean(0)) / held.total)


def test_range_finder_of_wide_vectors_of_low_rank(spark):
    """More features than rows, and fewer directions than asked for."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 900))
    mean, basis, share = vectors.range_pca(table(spark, x), 900, 5)
    c = x - x.mean(0)
    assert np.allclose(c @ basis @ basis.T, c, atol=1e-6) and abs(share[:3].sum() - 1) < 1e-9


def test_cache_computes_what_is_new(spark, tmp_path):
    calls = []

    def compute(rows):
        calls.append(sorted(map(str, (r.v for r in rows.collect()))))
        return rows.selectExpr("source", "transform(v, x -> 2 * x) result")

    kept = cache.ResultCache(spark, f"{tmp_path}/cache", "array<double>")
    rows = table(spark, [[1, 2], [3, 4], [1, 2], None])
    get = lambda df, model="a", mode="hard": {r.id: r.out for r in kept.get(df, ["v"], model, mode, compute, "out").collect()}
    want = {0: [2, 4], 1: [6, 8], 2: [2, 4], 3: None}
    assert get(rows) == want and len(calls) == 1 and len(calls[0]) == 3
    assert get(rows) == want and len(calls) == 1
    assert get(table(spark, [[1, 2], [5, 6]])) == {0: [2, 4], 1: [10, 12]} and calls[1] == ["[5.0, 6.0]"]
    get(rows, "b"), get(rows, "a", "soft")
    assert [len(c) for c in calls] == [3, 1, 3, 3]
    centres = table(spark, [[1, 0], [0, 1]]).selectExpr("id label", "v c")
    assert cache.model_digest(centres) == cache.model_digest(centres.repartition(3)) != cache.model_digest(centres.where("label = 0"))
    assert get(rows.where("false")) == {}


def images(spark):
    rng = np.random.default_rng(1)
    return [(k, 4, 6, rng.uniform(size=72).tolist(), [10.0, 3.0, 12.0, 2.0]) for k in range(4)] + [(4, 4, 6, None, None), (5, 4, 6, [1.0], None), (6, 4, 6, [0.0] * 72, None)]


IMAGE = "id long, height int, width int, values array<double>, camera array<double>"


def test_chain_of_blocks_is_checked_fused_and_run(spark):
    rng = np.random.default_rng(2)
    models = {"p": (rng.normal(size=9), rng.normal(size=(9, 4))), "q": (rng.normal(size=4), rng.normal(size=(4, 3))), "r": (rng.normal(size=3), rng.normal(size=(3, 3))), "v": rng.normal(size=(5, 3)).tolist()}
    config = [{"type": "normalise", "args": {"mean": [0.5, 0.4, 0.3], "deviation": [0.2, 0.2, 0.1]}}, {"type": "stub", "args": {"patch": 2}}, *({"type": "pca", "args": {"model": k}} for k in "pqr"), {"type": "pca_vlad", "args": {"pca": "r", "vlad": "v"}}]
    chain = blocks.setup(config, models)
    assert chain.output_feature_keys == ("pca_0", "pca_1", "pca_2", "vlad_0", "vlad_1", "vlad_2", "vlad_3", "vlad_4")
    assert [type(b).__name__ for b in blocks.fused(chain.blocks)] == ["Linear", "PatchStatistics", "Linear", "_Both"]
    got = {r.id: r for r in chain.run(spark.createDataFrame(images(spark), IMAGE), ["id"]).collect()}
    for k, h, w, values, camera in images(spark):
        if values is None or len(values) == 1:
            assert got[k]["values"] is None
            continue
        x = original = np.array(values).reshape(h, w, 3)
        for b in chain.blocks:
            x = b.open()(x, original)
        assert np.allclose(np.reshape(got[k]["values"], (2, 3, 8)), x) and (got[k].height, got[k].width) == (2, 3)
        assert got[k].camera == (None if camera is None else [5.0, 1.5, 6.0, 1.0])


def test_blocks_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="9 features, gets 3"):
        blocks.setup([{"type": "pca", "args": {"model": "p"}}], {"p": (np.zeros(9), np.zeros((9, 2)))})
    with pytest.raises(ValueError, match="unknown"):
        blocks.setup([{"type": "dino"}], {})
    with pytest.raises(ValueError, match="entries"):
        blocks.setup([{"type": "vlad", "args": {"model": "v"}}], {"v": [[1.0, 2.0]]})
    named = blocks.setup([{"type": "traversability_prototypes", "args": {"model": "t"}}], {"t": {"rock": [1, 0, 0], "grass": [0, 1, 0]}})
    assert named.output_feature_keys == ("rock", "grass")


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def loader():
        import uuid

        open(f"{folder}/{uuid.uuid4()}", "w").close()
        return lambda image: image.sum(-1, keepdims=True)

    chain = blocks.Pipeline((blocks.Featurizer(loader, ("sum",)),))
    out = chain.run(spark.createDataFrame(images(spark)[:4], IMAGE).coalesce(1), ["id"]).collect()
    assert len(out) == 4 and len(list(tmp_path.iterdir())) == 1


def record(root, run, topic, frames, stamps=True):
    path = root / run / topic
    path.mkdir(parents=True, exist_ok=True)
    for k in frames:
        np.save(path / f"{k:08d}.npy", np.full((2, 2), float(k)))
    if stamps:
        (path / "timestamps.txt").write_text("\n".join(str(0.5 * k) for k in range(max(frames) + 1)))


@pytest.fixture()
def source(spark):
    spark.dataSource.register(runs.RunFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda root: spark.read.format("run_frames").load(str(root))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_run_folders_as_a_table(spark, source, tmp_path):
    record(tmp_path, "a", "voxel", range(5))
    record(tmp_path, "a", "image", [0, 3], stamps=False)
    record(tmp_path, "b", "voxel", range(300))
    rows = source(tmp_path).collect()
    assert len(rows) == 307 and {(r.run, r.topic) for r in rows} == {("a", "voxel"), ("a", "image"), ("b", "voxel")}
    assert all(r["values"] == [float(r.frame)] * 4 and r.shape == [2, 2] and r.stamp == (None if r.topic == "image" else 0.5 * r.frame) for r in rows)
    # Broken frames of what is not asked for are never opened.
    (tmp_path / "b" / "voxel" / "00000007.npy").write_text("broken")
    (tmp_path / "a" / "image" / "00000003.npy").write_text("broken")
    ask = lambda c: sorted((r.run, r.topic, r.frame) for r in source(tmp_path).where(c).collect())
    assert ask("run = 'a' and topic = 'voxel' and frame >= 2 and frame < 4") == [("a", "voxel", 2), ("a", "voxel", 3)]
    assert ask("run in ('b', 'c') and frame > 290 and frame % 2 = 0") == [("b", "voxel", k) for k in range(292, 300, 2)]
    assert ask("frame = 0 and stamp is null") == [("a", "image", 0)]
    assert ask("run = 'none'") == []
    with pytest.raises(Exception, match="broken|pickle|magic"):
        ask("run = 'b'")


def test_run_folders_as_a_stream(spark, source, tmp_path):
    """The same rows as the table, in two turns, also after a restart; frames that are added come once."""
    root, out = tmp_path / "runs", f"{tmp_path}/out"
    record(root, "a", "voxel", range(3))

    def turn():
        stream = spark.readStream.format("run_frames").load(str(root))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run, r.topic, r.frame) for r in spark.read.parquet(out).collect())

    assert turn() == [("a", "voxel", k) for k in range(3)]
    record(root, "a", "voxel", range(3, 6))
    record(root, "b", "image", range(2))
    assert turn() == sorted((r.run, r.topic, r.frame) for r in source(root).collect())
    assert len(turn()) == 8


def test_vectors_and_quaternions_of_zeros(spark):
    rows, centres = table(spark, [[0, 0], [3, 4], None]), table(spark, [[1, 0], [0, 0]]).selectExpr("id label", "v c")
    at = {r.id: (r.centre, r.cosine) for r in vectors.assign(rows, centres, ["id"]).collect()}
    assert at[0] == (0, 0.0) and at[1][0] == 0 and abs(at[1][1] - 0.6) < 1e-12 and at[2][1] is None
    assert {r.id: r.obstacle_score for r in vectors.prototype_scores(rows, [[1.0, 0.0]], [[0.0, 0.0], [0.0, 1.0]], ["id"]).collect()}[0] == 0.0
    assert [r.u for r in rows.select(geometry.unit(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8], None]
    assert vectors.soft_vlad(rows.where("v is not null"), centres, "label", 1.0).where("x is null").count() == 0
    q = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 2.0)], "x double, y double, z double, w double")
    turned = q.select(*(c.alias(a) for a, c in zip("abc", geometry.transform((F.lit(1.0), F.lit(2.0), F.lit(3.0)), geometry.pose_matrix((F.lit(0.0),) * 3, tuple(F.col(c) for c in "xyzw"))), strict=True)))
    assert [tuple(r) for r in turned.collect()] == [(None, None, None), (1.0, 2.0, 3.0)]


def test_soft_vlad_over_blocks_of_centres(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows, centres = table(spark, rng.normal(size=(30, 4))), table(spark, rng.normal(size=(9, 4))).selectExpr("id label", "v c")
    get = lambda: {(r.label, r.centre, r.d): r.x for r in vectors.soft_vlad(rows, centres, "label", 2.0).collect()}
    whole = get()
    monkeypatch.setattr(vectors, "BLOCK", 3)
    parts = get()
    assert set(whole) == set(parts) and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)


def test_accuracy_and_weights_of_maps(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (-1, 5), (3, None)], "l int, p int")
    assert tuple(vectors.accuracy(df, "l", "p").first()) == (4, 0.5)
    entry = "k long, coords array<struct<seq:int,cam:int,u:double,v:double,w:double>>"
    old, new = spark.createDataFrame([(1, [(1, 0, 1.0, 1.0, 2.0)])], entry), spark.createDataFrame([(2, [(1, 0, 1.0, 1.0, 0.2)])], entry)
    weights = lambda most: [c.w for r in pixels.merge_coords(old, new, ["k"], 3, 0.5, most).orderBy("k").collect() for c in r.coords]
    assert weights(None) == [1.0, 1.0] and weights(1.0) == [2.0, 1.0]


def test_clouds_as_records_and_back(spark):
    rows = [(f, k, float(k), 0.5 * k, -1.0, 0x10203 + k) for f in (3, 5) for k in range(20)]
    df = spark.createDataFrame(rows, "frame_id long, k long, x double, y double, z double, rgb long").repartition(7)
    packed = files.pack_points(df, order="k", colour=True)
    assert {r.frame_id: (r.n, len(r.content)) for r in packed.collect()} == {3: (20, 320), 5: (20, 320)}
    back = files.packed_points(packed, colour=True).collect()
    assert [(r.frame_id, r.x, r.y, r.z, r.rgb) for r in sorted(back, key=lambda r: (r.frame_id, r.x))] == [(f, x, y, z, c) for f, _, x, y, z, c in rows]


def test_covariances_of_all_scans_in_one_fold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for scan in range(5):
        for key in range(12):
            if rng.random() < 0.7:
                a = rng.normal(size=(3, 3))
                c = a @ a.T + np.eye(3)
                rows.append((key, scan, float(rng.uniform()), *map(float, (c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2])), *map(float, rng.normal(size=3))))
    names = ["f", *(f"cov_{k}" for k in covariance.SIX), *(f"center_{a}" for a in "xyz")]
    df = spark.createDataFrame(rows, "key long, scan long, " + ", ".join(f"{n} double" for n in names))
    chained = None
    for scan in range(5):
        one = df.where(F.col("scan") == scan).drop("scan")
        chained = one if chained is None else covariance.merge(chained, one, ["key"], ["f"])
    want, got = ({r.key: [r[n] for n in names] for r in d.collect()} for d in (chained, covariance.merge_all(df, ["key"], ["f"], "scan")))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_map_message_tells_masked_from_absent(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (1, 2, 3.0)], "i int, j int, z double")
    got = {r.layer: r["values"] for r in columns.grid_map(cells, ["z"], 2, 3, F.col("z") < 2.5, {"flat": 7.0}).collect()}
    assert got["z"][5] == 1.0 and got["z"][4] == 2.0 and got["z"][0] != got["z"][0] and got["z"][1:4] == [None] * 3
    assert got["flat"] == [7.0, None, None, None, 7.0, 7.0]


def test_length_of_a_vector_is_worked_out_once(spark):
    """Not for each entry, and a pass over all vectors is numpy's: no formula of a centre stands in its plan."""
    from terravox.functions.geometry import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(unit(F.col("v")).alias("u"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_nearest_of_a_batch():
    import pyarrow as pa

    column = pa.array([[1.0, 0.0], None, [0.0, 0.0], [-2.0, 2.0], [1.0, 1.0]], pa.list_(pa.float64()))
    known, x, at, cosine = vectors._near(column, np.array([[0.0, 1.0], [5.0, 0.0], [0.0, 0.0]]))
    assert known.tolist() == [True, False, True, True, True] and x.shape == (4, 2)
    assert at.tolist() == [1, 0, 0, 0] and np.allclose(cosine, [1.0, 0.0, 0.5**0.5, 0.5**0.5])
    with pytest.raises(ValueError, match="width"):
        vectors._near(pa.array([[1.0], [1.0, 2.0]], pa.list_(pa.float64())), np.zeros((1, 2)))
