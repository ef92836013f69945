"""Symmetric 3 x 3 covariances as six columns, in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a symmetric matrix in this order.
SIX = ("xx", "xy", "xz", "yy", "yz", "zz")
Six = tuple[Column, ...]


def of(prefix: str) -> Six:
    return tuple(F.col(f"{prefix}_{k}") for k in SIX)


def determinant(m: Six) -> Column:
    a, b, c, d, e, f = m
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def inverse(m: Six, eps: float = 1e-6) -> Six:
    """Inverse after eps is added to the diagonal."""
    a, b, c, d, e, f = m
    a, d, f = a + eps, d + eps, f + eps
    det = determinant((a, b, c, d, e, f))
    return tuple(x / det for x in (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b))


def positive(m: Six) -> Column:
    """All leading minors above zero."""
    a, b, _, d, *_ = m
    return (a > 0) & (a * d - b * b > 0) & (determinant(m) > 0)


def quantile(rows: DataFrame, value: Column, share: float, bins: int = 1024) -> float | None:
    """The exact quantile, interpolated between neighbours, of a column without nulls and NaN.

    Histograms over ever narrower spans find the value of the rank: each pass brings at most `bins` rows to the driver,
    and no task holds more than its own bins.
    """
    seen = rows.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = seen.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = share * (n - 1)
    rank = math.floor(place)
    below = 0
    while low < high:
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins))
        parts = seen.where(F.col("v").between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for part in sorted(parts, key=lambda r: r["b"]):
            low, high = part["lo"], part["hi"]
            if rank < below + part["n"]:
                break
            below += part["n"]
    first = low
    if place == rank:
        return first
    after = seen.agg(F.count(F.when(F.col("v") <= first, 1)).alias("n"), F.min(F.when(F.col("v") > first, F.col("v"))).alias("v")).first()
    return first if after["n"] > rank + 1 else (rank + 1 - place) * first + (place - rank) * after["v"]


def without_outliers(rows: DataFrame, prefix: str, share: float = 0.99, slack: float = 0.0) -> DataFrame:
    """Rows whose trace is not above the quantile of the table (one number on the driver) by more than the slack."""
    trace = of(prefix)[0] + of(prefix)[3] + of(prefix)[5]
    limit = quantile(rows, trace, share)
    return rows.where(trace <= F.lit(None if limit is None else limit + slack).cast("double"))


def fuse_points(rows: DataFrame, key: list[str], prefix: str, features: list[str]) -> DataFrame:
    """Per key: covariance of the mean precision, precision-weighted centre, mean features."""
    p = inverse(of(prefix))
    xyz = [F.col(a) for a in "xyz"]
    full = [[p[0], p[1], p[2]], [p[1], p[3], p[4]], [p[2], p[4], p[5]]]
    weighted = {f"_b{r}": sum((full[r][c] * xyz[c] for c in range(1, 3)), full[r][0] * xyz[0]) for r in range(3)}
    sums = rows.withColumns({f"_p_{k}": v for k, v in zip(SIX, p, strict=True)} | weighted).groupBy(*key).agg(*(F.avg(f"_p_{k}").alias(f"_p_{k}") for k in SIX), *(F.avg(f"_b{r}").alias(f"_b{r}") for r in range(3)), *(F.avg(f).alias(f) for f in features))
    c = inverse(of("_p"))
    square = [[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]
    centre = {f"center_{a}": sum((square[r][k] * F.col(f"_b{k}") for k in range(1, 3)), square[r][0] * F.col("_b0")) for r, a in enumerate("xyz")}
    return sums.select(*key, *features, *(v.alias(f"cov_{k}") for k, v in zip(SIX, c, strict=True)), *(v.alias(k) for k, v in centre.items()))


def _joint(a, b, features: list[str]) -> dict[str, Column]:
    """Both Gaussians in one, from what a and b give by name: covariance inv(half of each precision), mean centre, features by the peaks."""
    ca, cb = (tuple(s(f"cov_{k}") for k in SIX) for s in (a, b))
    half = tuple(0.5 * x + 0.5 * y for x, y in zip(inverse(ca), inverse(cb), strict=True))
    plus = lambda m: (m[0] + 1e-6, m[1], m[2], m[3] + 1e-6, m[4], m[5] + 1e-6)
    weight = lambda m: F.exp(-0.5 * (3 * math.log(2 * math.pi) + F.log(determinant(plus(m)))))
    wa, wb = weight(ca), weight(cb)
    made = {f: (wa * a(f) + wb * b(f)) / (wa + wb + 1e-6) for f in features}
    made |= {f"cov_{k}": v for k, v in zip(SIX, inverse(half), strict=True)} | {f"center_{x}": (a(f"center_{x}") + b(f"center_{x}")) / 2 for x in "xyz"}
    return {c: F.coalesce(v, a(c), b(c)) for c, v in made.items()}


def merge(a: DataFrame, b: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Keys of both tables, those of one as they are."""
    one, two = (df.select(*key, *(F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in key)) for n, df in (("a", a), ("b", b)))
    joint = _joint(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), features)
    return one.join(two, key, "full").select(*key, *(v.alias(c) for c, v in joint.items()))


def merge_all(scans: DataFrame, key: list[str], features: list[str], order: str) -> DataFrame:
    """merge of all scans in order, at once: one shuffle and a left fold over at most one entry per scan of each key."""
    names = [*features, *(f"cov_{k}" for k in SIX), *(f"center_{x}" for x in "xyz")]
    listed = scans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("_s"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x[order].alias(order), *(v.alias(c) for c, v in _joint(lambda c: acc[c], lambda c: x[c], features).items()))

    return listed.select(*key, F.aggregate(F.slice("_s", 2, 1 << 30), F.get("_s", F.lit(0)), step).alias("_f")).select(*key, *(F.col(f"_f.{c}").alias(c) for c in names))
