"""Queries over fitted vocabularies of vectors, palettes, resized images and synthetic terrain."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import pixels, vectors
from ..sources import tables
from ..sources.tables import round6
from . import terrain
from .registry import _centres, _COS, _units, query, r6, rounded

ROUNDS = 2


def _kmeans_sql() -> str:
    out = "+u AS (SELECT vec_id, list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS v FROM desc_), c0 AS (SELECT vec_id AS label, v AS c FROM u WHERE vec_id < 6)"
    for k in range(1, ROUNDS + 1):
        out += f", a{k} AS (SELECT * FROM (SELECT label, v, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, label) AS r FROM u CROSS JOIN c{k - 1}) WHERE r = 1)"
        out += f", s{k} AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS d, unnest(v) AS x FROM a{k}) GROUP BY label, d)"
        out += f", c{k} AS (SELECT label, coalesce(n.c, o.c) AS c FROM c{k - 1} o LEFT JOIN (SELECT label, list(x ORDER BY d) AS c FROM s{k} GROUP BY label) n USING (label))"
    return out + f" SELECT label, d, {r6('x')} AS x FROM (SELECT label, unnest(range(64)) AS d, unnest(c) AS x FROM c{ROUNDS})"


@query(_kmeans_sql(), "desc_")
def kmeans_vocabulary(spark, d):
    """Centres of the unit vectors, from the first six on."""
    rows = tables.descriptors(spark, d).select("vec_id", geometry.unit(F.col("v")).alias("v"))
    made = vectors.kmeans(rows, rows.where("vec_id < 6").select(F.col("vec_id").alias("label"), F.col("v").alias("c")), ROUNDS)
    return rounded(made.select("label", F.posexplode("c").alias("d", "x")).withColumn("d", F.col("d").cast("long")), "x")


_NORMED = "n AS (SELECT label, centre, d, x / sqrt(sum(x * x) OVER (PARTITION BY label, centre)) AS x FROM s)"


@query(f"+{_COS}, w AS (SELECT *, exp(2.0 * cosine) / sum(exp(2.0 * cosine)) OVER (PARTITION BY vec_id) AS w FROM pair), a AS (SELECT label, centre, w, unnest(range(64)) AS d, unnest(v) - unnest(c) AS x FROM w), s AS (SELECT label, centre, d, sum(w * x) AS x FROM a GROUP BY ALL), {_NORMED} SELECT label, centre, d, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY label))')} AS x FROM n", "desc_ means")
def vlad_soft(spark, d):
    made = vectors.soft_vlad(_units(spark, d), _centres(spark, d), "label", 2.0)
    return rounded(made.withColumn("d", F.col("d").cast("long")), "x")


@query(f"+{_COS}, a AS (SELECT label, centre, unnest(range(64)) AS d, unnest(v) - unnest(c) AS x FROM best WHERE k = 1), s AS (SELECT label, centre, d, sum(x) AS x FROM a GROUP BY ALL), {_NORMED}, r AS (SELECT label, d, sum(x) AS x FROM n GROUP BY ALL) SELECT label, d, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY label))')} AS x FROM r", "desc_ means")
def vlad_reduced(spark, d):
    assigned = vectors.assign(_units(spark, d), _centres(spark, d), ["vec_id", "label"])
    return rounded(vectors.reduced_vlad(vectors.vlad(assigned, "label"), "label").withColumn("d", F.col("d").cast("long")), "x")


@query()
def pca_vlad(spark, d):
    """Projection on four components and residuals to all centres, one after the other."""
    rows = tables.descriptors(spark, d)
    mean, basis, _ = vectors.fit_pca(rows, 64, 4)
    far = vectors.residuals(rows, _centres(spark, d), ["vec_id", "v"])
    both = F.concat(F.array(*vectors.project(F.col("v"), mean, basis.tolist())), "residuals")
    return far.select("vec_id", F.transform(both, lambda x: F.round(x, 6)).alias("features"))


_COLOURS = 64
_FIB = [[float(x) for x in c] for c in geometry.fibonacci_palette(_COLOURS)]


def _palette_sql(axis: str) -> str:
    def colour(k: int) -> str:
        turn, polar = 2 * math.pi * k / ((1 + 5**0.5) / 2), math.acos(1 - 2 * k / _COLOURS)
        return repr({"x": math.cos(turn) * math.sin(polar), "y": math.sin(turn) * math.sin(polar), "z": math.cos(polar)}[axis] / 2 + 0.5)

    return f"list_dot_product(w, [{', '.join(colour(k) for k in range(_COLOURS))}]::DOUBLE[]) / list_sum(w)"


@query(f"SELECT vec_id, {', '.join(f'{r6(_palette_sql(a))} AS {c}' for a, c in zip('xyz', 'rgb', strict=True))} FROM (SELECT vec_id, list_transform(CAST(v AS DOUBLE[]), lambda x: exp(x)) AS w FROM desc_)", "desc_")
def palette_colours(spark, d):
    """Colours of vectors, whose entries are made shares by a softmax, over a palette of as many."""
    colours = geometry.apply_palette(F.col("v"), _FIB, soft=True)
    return tables.descriptors(spark, d).select("vec_id", *(round6(c).alias(k) for k, c in colours.items()))


_WIDE = "px AS (SELECT vec_id, d % 8 AS pu, d // 8 AS pv, x AS value FROM (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_)), tgt AS (SELECT a AS ou, b AS ov, (a + 0.5) * 8 / 12 - 0.5 AS u, (b + 0.5) * 8 / 12 - 0.5 AS v FROM (SELECT unnest(range(12)) AS a) CROSS JOIN (SELECT unnest(range(12)) AS b)), k AS (SELECT ou, ov, CASE WHEN du = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN dv = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS w, greatest(0, least(7, floor(u) + du)) AS pu, greatest(0, least(7, floor(v) + dv)) AS pv FROM tgt CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(du, dv))"


@query(f"+{_WIDE} SELECT vec_id, ou, ov, {r6('sum(w * value)')} AS value FROM k JOIN px USING (pu, pv) GROUP BY vec_id, ou, ov", "desc_")
def image_resize(spark, d):
    """Images of 8 x 8 at 12 x 12, between pixel centres; the edge goes on."""
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode("v").alias("d", "value"))
    image = each.select("vec_id", (F.col("d") % 8).cast("long").alias("u"), F.floor(F.col("d") / 8).alias("v"), "value")
    return rounded(pixels.resize(image, ["vec_id"], (8, 8), (12, 12)), "value")


@query(f"SELECT i, j, {r6('1.5 * sin(0.3 * i) * cos(0.2 * j)')} AS z, {r6('0.45 * cos(0.3 * i) * cos(0.2 * j)')} AS slope_x, {r6('-0.3 * sin(0.3 * i) * sin(0.2 * j)')} AS slope_y FROM (SELECT unnest(range(64)) AS i) CROSS JOIN (SELECT unnest(range(64)) AS j)")
def synthetic_wave(spark, d):
    return rounded(terrain.wave(spark, 64, 1.5, 0.3, 0.2), "z", "slope_x", "slope_y")
