"""Normalisation of channel vectors before and after a network, and positions as waves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means and deviations of the usual image collection, by channel.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _row(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalised(v: Column, mean=MEAN, deviation=DEVIATION) -> Column:
    return F.zip_with(F.zip_with(v, _row(mean), lambda a, m: a - m), _row(deviation), lambda a, s: a / s)


def restored(v: Column, mean=MEAN, deviation=DEVIATION) -> Column:
    return F.zip_with(F.zip_with(v, _row(deviation), lambda a, s: a * s), _row(mean), lambda a, m: a + m)


def layer_norm(v: Column, eps: float = 1e-6, weight=None, bias=None) -> Column:
    """A vector less its mean, over the root of its variance + eps; then weight and bias by entry."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size(v)
    centred = F.transform(v, lambda x: x - total(v) / n)
    size = F.sqrt(total(F.transform(centred, lambda x: x * x)) / n + eps)
    out = F.transform(centred, lambda x: x / size)
    out = out if weight is None else F.zip_with(out, _row(weight), lambda a, w: a * w)
    return out if bias is None else F.zip_with(out, _row(bias), lambda a, b: a + b)


def centred_min_max(df: DataFrame, columns: list[str], least: float = 1e-4) -> DataFrame:
    """Columns scaled by their bounds over the whole table to [-0.5, 0.5]; spans below `least` count as that. The bounds are one row."""
    ends = df.agg(*(F.min(c).alias(f"_l{k}") for k, c in enumerate(columns)), *(F.max(c).alias(f"_h{k}") for k, c in enumerate(columns)))
    met = df.crossJoin(F.broadcast(ends))
    scaled = {c: (F.col(c) - F.col(f"_l{k}")) / F.greatest(F.lit(least), F.col(f"_h{k}") - F.col(f"_l{k}")) - 0.5 for k, c in enumerate(columns)}
    return met.withColumns(scaled).select(*df.columns)


def frequencies(n: int) -> list[float]:
    return [math.exp(-2 + 12 * k / (n - 1)) if n > 1 else math.exp(-2) for k in range(n)]


def waves(i: Column, j: Column, height: int, width: int, channels: list[Column], n: int = 10) -> Column:
    """Features of a pixel: place on [-1, 1] and channels times n frequencies, as sines, then cosines, then the channels."""
    on = lambda c, size: c * (2.0 / (size - 1)) - 1.0 if size > 1 else F.lit(-1.0)
    base = [on(i, height), on(j, width), *channels]
    turned = [c * F.lit(f) for f in frequencies(n) for c in base]
    return F.array(*(F.sin(c) for c in turned), *(F.cos(c) for c in turned), *channels)
