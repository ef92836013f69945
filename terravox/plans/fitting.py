"""Queries over samples, fitted projections and vocabularies, cached results and chains of image blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks, pixels, sampling, vectors
from ..sources import tables
from ..sources.cache import ResultCache, model_digest
from ..sources.tables import META, round6
from ..sources.working import folder, written
from .registry import _centres, _COS, _units, _voxels, query, r6, rounded

_ENTRY = "(SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_)"


@query(f"+e AS (SELECT *, x > 0.1 AS positive, md5('7:' || vec_id || ':' || d) AS t FROM {_ENTRY}) SELECT vec_id, d, {r6('x')} AS x, positive FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, positive ORDER BY t, d) AS k FROM e) WHERE k <= CASE WHEN positive THEN 20 ELSE 5 END", "desc_")
def point_prompts(spark, d):
    """Of each image 20 pixels inside its mask and 5 outside, by the least tickets."""
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode("v").alias("d", "x")).withColumn("d", F.col("d").cast("long"))
    return rounded(sampling.prompts(each, "vec_id", ["d"], F.col("x") > 0.1, 20, 5, 7), "x")


@query(f"+{_COS} SELECT vec_id, {', '.join(f'{r6(f'max(cosine) FILTER (WHERE centre = {k})')} AS prototype_{k}' for k in (0, 1, 2))} FROM pair WHERE centre < 3 GROUP BY vec_id", "desc_ means")
def prototype_cosines(spark, d):
    """The cosine of each descriptor with each of three prototypes."""
    known = {r["label"]: r["c"] for r in _centres(spark, d).where("label < 3").collect()}
    named = {f"prototype_{k}": known[k] for k in sorted(known)}
    return rounded(vectors.prototype_cosines(_units(spark, d), named, ["vec_id"]), *named)


@query(f"+{_COS} SELECT vec_id, {r6('list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - c[i])))')} AS residual, centre FROM pair", "desc_ means")
def cached_residuals(spark, d):
    """Distances to the vocabulary through the cache: the second half of the vectors is computed after the first is known."""
    centres = _centres(spark, d)
    cache = ResultCache(spark, f"{folder(spark)}/residual-cache", "array<double>")
    compute = lambda rows: vectors.residuals(rows, centres, ["source"]).withColumnRenamed("residuals", "result")
    rows, model = _units(spark, d), model_digest(centres)
    cache.get(rows.where("vec_id % 2 = 0"), ["v"], model, "l1", compute, "far")
    whole = cache.get(rows, ["v"], model, "l1", compute, "far")
    return rounded(whole.select("vec_id", F.posexplode("far").alias("centre", "residual")).withColumn("centre", F.col("centre").cast("long")), "residual")


#: A chain of a stand-in for a network, a projection and a vocabulary.
_MODELS = {"p": ([0.01, -0.1, 0.1], [[0.8, -0.2], [0.3, 0.5], [-0.4, 0.6]]), "v": [[1.0, 0.0], [0.6, 0.8], [-0.7, 0.1]]}
_CHAIN = [{"type": "stub", "args": {"patch": 2}}, {"type": "pca", "args": {"model": "p"}}, {"type": "vlad", "args": {"model": "v"}}]
_SUM = lambda j: " + ".join(f"({s} - {m!r}) * {row[j]!r}" for s, m, row in zip(("mean", "least", "most"), *_MODELS["p"], strict=True))
_SIZE = "sqrt(a * a + b * b)"


@query(f"+p AS (SELECT vec_id, (d // 8) // 2 AS v, (d % 8) // 2 AS u, avg(x) AS mean, min(x) AS least, max(x) AS most FROM {_ENTRY} GROUP BY ALL), q AS (SELECT vec_id, u, v, ({_SUM(0)})::DOUBLE AS a, ({_SUM(1)})::DOUBLE AS b FROM p) SELECT vec_id, u, v, {', '.join(f'{r6(f'abs(a / {_SIZE} - {c[0]!r}::DOUBLE) + abs(b / {_SIZE} - {c[1]!r}::DOUBLE)')} AS vlad_{k}' for k, c in enumerate(_MODELS['v']))} FROM q", "desc_")
def image_blocks(spark, d):
    """Images of 8 x 8 through the chain, in one pass; names of the results are those that the chain tells beforehand."""
    chain = blocks.setup(_CHAIN, _MODELS, ("value",))
    images = tables.descriptors(spark, d).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("v").alias("values"))
    keys = chain.output_feature_keys
    each = chain.run(images, ["vec_id"]).select("vec_id", "width", F.posexplode("values").alias("at", "value"))
    place = F.floor(F.col("at") / len(keys))
    at = each.select("vec_id", (place % F.col("width")).alias("u"), F.floor(place / F.col("width")).alias("v"), (F.col("at") % len(keys)).alias("k"), "value")
    return rounded(at.groupBy("vec_id", "u", "v").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(c) for k, c in enumerate(keys))), *keys)


CAMERA = {"cam": 0, "width": 4, "height": 4, "p": [[2, -2, 0, -10], [2, 0, -2, -40], [1, 0, 0, -25]]}


@query()
def pca_of_recordings(spark, d):
    """A projection fitted to what a cloud shows of a budget of images, and how much of the features it holds.

    Every n-th image is taken; of each the distinct pixels that voxels fall on; an image is 4 x 4 pixels of four features.
    """
    images = sampling.frame_budget(tables.descriptors(spark, d).withColumn("idx", F.col("vec_id")), "vec_id", 500, first=10)
    places = {a: c for a, c in zip("xyz", META.centres().values(), strict=True)}
    seen = pixels.project(_voxels(spark, d).select("gx", "gy", "gz").withColumns(places), [CAMERA])
    distinct = seen.select(F.floor("u").cast("int").alias("pu"), F.floor("v").cast("int").alias("pv")).distinct()
    gathered = images.crossJoin(F.broadcast(distinct)).select("vec_id", "pu", "pv", F.slice("v", 4 * (4 * F.col("pv") + F.col("pu")) + 1, 4).alias("v"))
    mean, basis, _ = vectors.range_pca(gathered, 4, 2)
    held = vectors.norms(gathered, mean, np.asarray(basis))
    return held.select(*(round6(c).alias(c) for c in ("total", "projected", "residual")), F.transform("cumulative", lambda x: F.round(x, 6)).alias("cumulative"))


@query()
def seeded_vocabulary(spark, d):
    """A vocabulary of eight centres seeded in rounds and moved six times at most, with the number of vectors of each."""
    rows = written(_units(spark, d).select("vec_id", "v"), "units")
    centres = vectors.kmeans(rows, vectors.seed_centres(rows, 8, "vec_id", rounds=3), 6, tol=1e-6)
    return centres.select("label", "n", F.transform("c", lambda x: F.round(x, 6)).alias("c"))
