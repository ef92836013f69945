"""Queries over labels, masks, normalised channels, and tallies of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise
from ..operators import labels
from ..sources import tables
from ..sources.tables import round6
from ..streaming import mapper
from .motion import _POSES, _poses
from .registry import query, r6, rounded


@query("SELECT vec_id, c AS class_id, CAST(label = c AS DOUBLE) AS hot FROM desc_ CROSS JOIN (SELECT unnest(range(10)) AS c)", "desc_")
def label_one_hot(spark, d):
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode(labels.one_hot(F.col("label"), 10)).alias("class_id", "hot"))
    return each.withColumn("class_id", F.col("class_id").cast("long"))


#: Fine classes below 182 by sevens; the others are unknown.
_COARSE = {k: k // 7 for k in range(182)}


@query("SELECT fine, CASE WHEN fine = 255 THEN -1 WHEN fine < 182 THEN fine // 7 ELSE 0 END AS coarse, count(*) AS n FROM (SELECT o_custkey % 256 AS fine FROM orders) GROUP BY ALL")
def coarse_labels(spark, d):
    fine = tables.table(spark, d, "orders").select((F.col("o_custkey") % 256).alias("fine"))
    return fine.select("fine", labels.coarse(F.col("fine"), _COARSE).cast("long").alias("coarse")).groupBy("fine", "coarse").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, d, {r6('CASE WHEN hi > 0 THEN coalesce((x - lo) / nullif(hi - lo, 0), 0) ELSE x END')} AS x FROM (SELECT *, min(x) OVER (PARTITION BY label, d) AS lo, max(x) OVER (PARTITION BY label, d) AS hi FROM (SELECT vec_id, label, CAST(unnest(range(64)) AS BIGINT) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_))", "desc_")
def class_min_max(spark, d):
    """Each entry scaled within its class."""
    each = tables.descriptors(spark, d).select("vec_id", "label", F.posexplode("v").alias("d", "x"))
    rows = each.select("vec_id", F.col("d").cast("long").alias("d"), (F.col("label") * 64 + F.col("d")).alias("class"), "x")
    return rounded(labels.min_max_by(rows, "class", "x").select("vec_id", "d", "x"), "x")


@query("SELECT k AS bit, sum((event_id >> k) & 1) AS n FROM events CROSS JOIN (SELECT unnest(range(16)) AS k) GROUP BY k")
def bit_counts(spark, d):
    """How many events have each of the 16 lowest bits of their number set."""
    each = tables.table(spark, d, "events").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: labels.bit(F.col("event_id"), k).cast("long"))).alias("bit", "one"))
    return each.groupBy(F.col("bit").cast("long").alias("bit")).agg(F.sum("one").alias("n"))


@query("SELECT vec_id, p // 16 AS u, p % 16 AS v FROM (SELECT vec_id, unnest(range(CAST(b - n AS BIGINT), CAST(b AS BIGINT))) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY k) AS b FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(list_transform(CAST(v AS DOUBLE[]), lambda x: CAST(floor(abs(x) * 20) AS BIGINT))) AS n FROM desc_)) WHERE k % 2 = 1)", "desc_")
def mask_pixels(spark, d):
    """Pixels of masks whose runs have lengths by the entries of a vector; images are 16 high."""
    lengths = F.transform("v", lambda x: F.floor(F.abs(x) * 20).cast("long"))
    return labels.mask_pixels(tables.descriptors(spark, d).select("vec_id", lengths.alias("n")), ["vec_id"], "n", 16)


@query(f"SELECT vec_id, c, {r6('(x - [0.485, 0.456, 0.406][c % 3 + 1]) / [0.229, 0.224, 0.225][c % 3 + 1]')} AS normalised, {r6('x')} AS restored FROM (SELECT vec_id, unnest(range(64)) AS c, unnest(CAST(v AS DOUBLE[])) AS x FROM desc_)", "desc_")
def channel_normalise(spark, d):
    """Entries as channels by turns."""
    mean, deviation = ((values * 22)[:64] for values in (normalise.MEAN, normalise.DEVIATION))
    made = normalise.normalised(F.col("v"), mean, deviation)
    both = tables.descriptors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(made.alias("n"), normalise.restored(made, mean, deviation).alias("r"))).alias("c", "z"))
    return both.select("vec_id", F.col("c").cast("long").alias("c"), round6(F.col("z.n")).alias("normalised"), round6(F.col("z.r")).alias("restored"))


@query(f"SELECT vec_id, d, {r6('(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-6) * 2.0 + 0.5')} AS x FROM (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(v) AS DOUBLE) AS x FROM desc_) WINDOW w AS (PARTITION BY vec_id)", "desc_")
def layer_norm(spark, d):
    made = normalise.layer_norm(F.col("v"), weight=[2.0] * 64, bias=[0.5] * 64)
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode(made).alias("d", "x"))
    return rounded(each.withColumn("d", F.col("d").cast("long")), "x")


_SPAN = ", ".join(r6(f"({c} - min({c}) OVER ()) / greatest(1e-4, max({c}) OVER () - min({c}) OVER ()) - 0.5") + f" AS {c}" for c in ("z", "top"))


@query(f"SELECT i, j, {_SPAN} FROM cells", "cells")
def centred_min_max(spark, d):
    made = normalise.centred_min_max(tables.cells(spark, d).select("i", "j", "z", "top"), ["z", "top"])
    return rounded(made, "z", "top")


def _waves_sql() -> str:
    base = ["i * (2.0 / 7) - 1", "j * (2.0 / 7) - 1", "c0", "c1"]
    turned = [f"({b}) * {f!r}::DOUBLE" for f in normalise.frequencies(4) for b in base]
    every = ", ".join([f"sin({t})" for t in turned] + [f"cos({t})" for t in turned] + ["c0", "c1"])
    return f"SELECT vec_id, k, {r6('x')} AS x FROM (SELECT vec_id, unnest(range(34)) AS k, unnest([{every}]) AS x FROM (SELECT vec_id, vec_id % 8 AS i, (vec_id // 8) % 8 AS j, CAST(v[1] AS DOUBLE) AS c0, CAST(v[2] AS DOUBLE) AS c1 FROM desc_))"


@query(_waves_sql(), "desc_")
def wave_features(spark, d):
    """Place and colour of pixels as sines and cosines; a vector is a pixel of an 8 x 8 image."""
    i, j = F.col("vec_id") % 8, F.floor(F.col("vec_id") / 8) % 8
    made = normalise.waves(i, j, 8, 8, [F.col("v")[0], F.col("v")[1]], 4)
    each = tables.descriptors(spark, d).select("vec_id", F.posexplode(made).alias("k", "x"))
    return rounded(each.withColumn("k", F.col("k").cast("long")), "x")


@query("SELECT run, count(*) AS steps, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok) = 0 AS succeeded FROM (SELECT run, event_type, coalesce(max(p) < 400, false) AS ok FROM odo GROUP BY run, event_type) GROUP BY run", "odo")
def run_tally(spark, d):
    """Runs whose every kind of step went well: no value reached 400."""
    status = tables.odometry(spark, d).groupBy("run", "event_type").agg((F.max("p") < 400).alias("ok"))
    return labels.tally(status, "run", F.col("ok"))


@query(f"WITH {_POSES} SELECT t AS stamp, 'odom' AS frame_id, 'base_link' AS child_frame_id, {r6('px')} AS x, {r6('py')} AS y, {r6('pz')} AS z, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, {r6('qz')} AS qz, {r6('qw')} AS qw FROM pose")
def odometry_transforms(spark, d):
    made = mapper.transforms(_poses(spark, d))
    return made.select("stamp", "frame_id", "child_frame_id", *(round6(F.col(f"translation.{a}")).alias(a) for a in "xyz"), *(F.col(f"rotation.{a}").alias(f"q{a}") for a in "xy"), *(round6(F.col(f"rotation.{a}")).alias(f"q{a}") for a in "zw"))
