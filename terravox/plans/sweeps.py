"""Parameter sweeps: made-up wave terrains for every combination of settings, and how well slopes are recovered on them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stencil
from .registry import query, r6, rounded

NAMES = ("fx", "fy", "ax", "ay", "noise")


def configs(spark: SparkSession, *values: Sequence[float]) -> DataFrame:
    """Every combination of frequencies, amplitudes and noise ranges (in hundredths), numbered; a small table."""
    rows = [(k, *map(float, c)) for k, c in enumerate(itertools.product(*values))]
    return spark.createDataFrame(rows, "config long, " + ", ".join(f"{n} double" for n in NAMES))


def terrains(waves: DataFrame, n: int, side: float, unit: Column) -> DataFrame:
    """Cells (config, i, j, z, true_x, true_y) of n x n maps from -side / 2 to side / 2, one of each configuration.

    unit is a column over i and j in [0, 1): the noise, the same of each configuration but for its range.
    """
    cells = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    at = waves.withColumn("i", F.explode(cells)).withColumn("j", F.explode(cells))
    x, y = (F.col(c) * (side / (n - 1)) - side / 2 for c in "ij")
    z = F.col("ax") * F.cos(F.col("fx") * x) + F.col("ay") * F.cos(F.col("fy") * y) + (unit - 0.5) * F.col("noise") / 100
    return at.select("config", "i", "j", z.alias("z"), (-F.col("ax") * F.col("fx") * F.sin(F.col("fx") * x)).alias("true_x"), (-F.col("ay") * F.col("fy") * F.sin(F.col("fy") * y)).alias("true_y"))


def slope_errors(maps: DataFrame, n: int, resolution: float, kinds: Sequence[str], radius: float, border: int) -> DataFrame:
    """Mean absolute errors of slopes and mean angle of normals in degrees by configuration and kernel, without the border.

    All maps of a kernel go through one stencil: each is moved along i, with a gap wider than the kernel between two.
    """
    gap = n + 2 * (round(radius / resolution) + 1)
    flat = maps.select("config", "true_x", "true_y", (F.col("i") + F.col("config") * gap).alias("i"), "j", "z", F.lit(1.0).alias("m"))
    inner = lambda c: F.col(c).between(border, n - 1 - border)
    out = None
    for kind in kinds:
        got = stencil.slope(flat, "z", "m", kind, radius, resolution).withColumn("i", F.col("i") - F.col("config") * gap).where(inner("i") & inner("j"))
        cosine = (1 + F.col("slope_x") * F.col("true_x") + F.col("slope_y") * F.col("true_y")) / F.sqrt((1 + F.col("slope_x") ** 2 + F.col("slope_y") ** 2) * (1 + F.col("true_x") ** 2 + F.col("true_y") ** 2))
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
        part = got.groupBy("config").agg(F.avg(F.abs(F.col("slope_x") - F.col("true_x"))).alias("error_x"), F.avg(F.abs(F.col("slope_y") - F.col("true_y"))).alias("error_y"), F.avg(angle).alias("angle"))
        part = part.withColumn("kernel", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_SETS = ([0.2, 0.4], [0.1, 0.3], [1.0], [0.5, 2.0], [0.0, 5.0])
_LISTS = ", ".join(f"({k}, {', '.join(f'{float(v)!r}::DOUBLE' for v in c)})" for k, c in enumerate(itertools.product(*_SETS)))
_X, _Y = "(i * (20.0 / 23) - 10.0)", "(j * (20.0 / 23) - 10.0)"
#: The noise of a cell: the same on both sides, without a generator.
_UNIT = "((i * 7919 + j * 104729) % 1000) / 1000.0"


@query(
    f"SELECT config, i, j, {r6(f'ax * cos(fx * {_X}) + ay * cos(fy * {_Y}) + ({_UNIT} - 0.5) * noise / 100')} AS z, {r6(f'-ax * fx * sin(fx * {_X})')} AS true_x, {r6(f'-ay * fy * sin(fy * {_Y})')} AS true_y "
    f"FROM (VALUES {_LISTS}) w(config, fx, fy, ax, ay, noise) CROSS JOIN (SELECT unnest(range(24)) AS i) CROSS JOIN (SELECT unnest(range(24)) AS j)"
)
def wave_sweep(spark, d):
    return rounded(terrains(configs(spark, *_SETS), 24, 20.0, F.expr(_UNIT)), "z", "true_x", "true_y").withColumn("config", F.col("config").cast("int"))


#: Scharr's kernel of 3 x 3 cells, as weights by place.
_TAPS = ", ".join(f"({a}, {b}, {3.0 * a / 32.0 if b else 10.0 * a / 32.0}::DOUBLE, {3.0 * b / 32.0 if a else 10.0 * b / 32.0}::DOUBLE)" for a in (-1, 0, 1) for b in (-1, 0, 1))


@query(
    f"WITH w AS (SELECT * FROM (VALUES {_LISTS}) w(config, fx, fy, ax, ay, noise)), m AS (SELECT config, i, j, ax * cos(fx * {_X}) + ay * cos(fy * {_Y}) + ({_UNIT} - 0.5) * noise / 100 AS z, -ax * fx * sin(fx * {_X}) AS tx, -ay * fy * sin(fy * {_Y}) AS ty FROM w CROSS JOIN (SELECT unnest(range(24)) AS i) CROSS JOIN (SELECT unnest(range(24)) AS j)), "
    f"k AS (SELECT * FROM (VALUES {_TAPS}) k(a, b, wx, wy)), s AS (SELECT m.config, m.i, m.j, any_value(m.tx) AS tx, any_value(m.ty) AS ty, sum(wx * o.z) / (20.0 / 23) AS sx, sum(wy * o.z) / (20.0 / 23) AS sy FROM m CROSS JOIN k JOIN m o ON o.config = m.config AND o.i = m.i + a AND o.j = m.j + b WHERE m.i BETWEEN 2 AND 21 AND m.j BETWEEN 2 AND 21 GROUP BY m.config, m.i, m.j) "
    f"SELECT config, {r6('avg(abs(sx - tx))')} AS error_x, {r6('avg(abs(sy - ty))')} AS error_y, {r6('avg(degrees(acos(greatest(-1.0, least(1.0, (1 + sx * tx + sy * ty) / sqrt((1 + sx * sx + sy * sy) * (1 + tx * tx + ty * ty)))))))')} AS angle, 'scharr' AS kernel FROM s GROUP BY config"
)
def wave_sweep_errors(spark, d):
    maps = terrains(configs(spark, *_SETS), 24, 20.0, F.expr(_UNIT))
    made = slope_errors(maps, 24, 20.0 / 23, ["scharr"], 20.0 / 23, 2)
    return rounded(made, "error_x", "error_y", "angle").withColumn("config", F.col("config").cast("int"))
