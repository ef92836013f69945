"""Streams of stamps (microseconds): nearest matches, interpolation, overlaps and gates.

As-of lookups never sort a whole run in one task: time is cut into slices, the last row of each slice is carried to the
next by a window over slices (one row each), and rows are matched within their slice. Rows that look at a number of rows
before them are numbered by slices in the same way and dealt to blocks of equal numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.working import written


def _as_of(left: DataFrame, right: DataFrame, key: str, fields: list[str], slice_us: int, after: bool) -> DataFrame:
    """left with _found: the struct (t, fields) of the key's last right row at or before (or first after) t."""
    sign = -1 if after else 1
    at = lambda df, side: df.withColumns({"_s": F.floor(sign * F.col("t") / slice_us).cast("long"), "_side": F.lit(side)})
    ours = at(right, 0).withColumn("_r", F.struct(F.col("t").alias("t"), *(F.col(f).alias(f) for f in fields))).select(key, "t", "_s", "_side", "_r")
    theirs = at(left, 1).withColumn("_l", F.struct(*left.columns))
    both = ours.unionByName(theirs.select(key, "t", "_s", "_side", "_l"), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_s").orderBy(sign * F.col("t"), F.col("_side") if not after else F.col("_side").desc())
    matched = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    last = ours.groupBy(key, "_s").agg((F.min_by if after else F.max_by)("_r", "t").alias("_end"))
    slices = last.unionByName(theirs.select(key, "_s").distinct().withColumn("_end", F.lit(None).cast(last.schema["_end"].dataType))).groupBy(key, "_s").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = slices.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_s", "_before")
    return matched.join(carried, [key, "_s"], "left").select("_l.*", F.coalesce("_in", "_before").alias("_found"))


def at_or_before(left: DataFrame, right: DataFrame, key: str, fields: list[str], slice_us: int) -> DataFrame:
    """left with _found, the struct (t, fields) of the key's last right row at or before its t."""
    return _as_of(left, right, key, fields, slice_us, False)


def nearest(left: DataFrame, right: DataFrame, key: str, fields: list[str], slice_us: int = 86_400_000_000, tolerance_us: int | None = None) -> DataFrame:
    """left with the fields of the right row nearest in time (the earlier of a tie), null beyond the tolerance."""
    both = neighbours(left, right, key, fields, slice_us)
    back, ahead = F.col("t") - F.col("_b.t"), F.col("_a.t") - F.col("t")
    chosen = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    found = both.withColumn("_m", chosen)
    if tolerance_us is not None:
        found = found.withColumn("_m", F.when(F.abs(F.col("t") - F.col("_m.t")) <= tolerance_us, F.col("_m")))
    return found.select(*left.columns, F.col("_m.t").alias("match_t"), *(F.col(f"_m.{f}").alias(f"match_{f}") for f in fields))


def neighbours(left: DataFrame, right: DataFrame, key: str, fields: list[str], slice_us: int = 86_400_000_000) -> DataFrame:
    """left with _b, the right row at or before it, and _a, the one after."""
    before = _as_of(left, right, key, fields, slice_us, False).withColumnRenamed("_found", "_b")
    return _as_of(before, right, key, fields, slice_us, True).withColumnRenamed("_found", "_a")


def interpolate(left: DataFrame, right: DataFrame, key: str, value: str, gap_us: int, slice_us: int = 86_400_000_000) -> DataFrame:
    """Linear value at each left stamp; null outside the samples or across a gap longer than gap_us."""
    both = neighbours(left, right, key, [value], slice_us)
    b, a = F.col("_b"), F.col("_a")
    share = (F.col("t") - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0))
    inside = a["t"] - b["t"] <= gap_us
    at = F.when(b["t"] == F.col("t"), b[value]).when(inside, b[value] + share * (a[value] - b[value]))
    return both.select(*left.columns, at.alias("at"))


def slerp(q0: list[Column], q1: list[Column], t: Column) -> list[Column]:
    """Unit quaternions between two, along the shorter way; close ones linearly."""
    cos = sum((a * b for a, b in zip(q0, q1, strict=True)), F.lit(0.0))
    sign = F.when(cos < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(cos)))
    w0, w1 = (F.when(angle < 1e-6, w).otherwise(F.sin(w * angle) / F.sin(F.greatest(angle, F.lit(1e-6)))) for w in (1 - t, t))
    return [w0 * a + w1 * sign * b for a, b in zip(q0, q1, strict=True)]


DAY = 86_400_000_000
#: Rows of a run that one window task orders, besides the few that it looks back at.
RUN_BLOCK = 4096


def numbered(rows: DataFrame, key: str, name: str, slice_us: int = DAY) -> DataFrame:
    """rows with their running number (1, 2, ...) by t in their key, null keys and stamps included.

    Rows of one stamp are ordered by a hash of all their columns, so that asking twice gives the same numbers.

    Rows are ordered within slices of time; a window over slices (one row each) adds up how many come before.
    """
    hashed = F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind))
    at = rows.withColumn("_s", F.floor(F.col("t") / slice_us).cast("long"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(F.col(key).alias("_key"), F.col("_s").alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_key", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = at.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_s").orderBy("t", hashed)))
    met = inside.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_slice")))
    return met.select(*rows.columns, (F.col("_i") + F.col("_o")).cast("long").alias(name))


def looking_back(rows: DataFrame, key: str, n: int, columns: dict, slice_us: int = DAY) -> DataFrame:
    """rows with columns made by functions of a window that holds each row and at least the n rows before it in its key.

    Numbered rows go to blocks of RUN_BLOCK; the last n of a block go to those after it as well, so that a run of any length
    is ordered by many tasks. What a function sees beyond n rows back hangs on the blocks: it must not look there.
    """
    at = lambda k: F.floor(k / RUN_BLOCK)
    k = F.col("_k") - 1
    dealt = numbered(rows, key, "_k", slice_us).withColumn("_block", F.explode(F.sequence(at(k), at(k + n))))
    order = Window.partitionBy(key, "_block").orderBy("_k")
    return dealt.withColumns({c: f(order) for c, f in columns.items()}).where(F.col("_block") == at(k)).drop("_block", "_k")


def without_repeats(rows: DataFrame, key: str, least_us: int, slice_us: int = DAY) -> DataFrame:
    """Rows whose stamp differs from the one before by more than least_us."""
    gaps = looking_back(rows, key, 1, {"_g": lambda w: F.col("t") - F.lag("t").over(w)}, slice_us)
    return gaps.where((F.col("_g") > least_us) | F.col("_g").isNull()).drop("_g")


def strided(rows: DataFrame, key: str, first: int, step: int, slice_us: int = DAY) -> DataFrame:
    """Every step-th row of a key by t, from number `first` (1: the earliest) on."""
    k = F.col("_k")
    return numbered(rows, key, "_k", slice_us).where((k >= first) & ((k - first) % step == 0)).drop("_k")


def band_counts(rows: DataFrame, key: str, back_us: int, ahead_us: int, name: str, slice_us: int = DAY) -> DataFrame:
    """rows with the number of rows of their key from t - back_us to t + ahead_us, both included.

    Keys must not be null; rows without a stamp have 0. The number is that of rows up to the band's end less that of rows before it: two as-of lookups among running numbers.
    """
    known = numbered(rows.select(key, "t"), key, "_n", slice_us).groupBy(key, "t").agg(F.max("_n").alias("_n"))
    ends = rows.withColumnRenamed("t", "_t")
    for shift, end in ((ahead_us, "_hi"), (-back_us - 1, "_lo")):
        asked = ends.withColumn("t", F.col("_t") + shift)
        ends = at_or_before(asked, known, key, ["_n"], slice_us).withColumn(end, F.coalesce(F.col("_found._n"), F.lit(0))).drop("_found", "t")
    return ends.withColumnRenamed("_t", "t").select(*rows.columns, (F.col("_hi") - F.col("_lo")).cast("long").alias(name))


def overlap_clip(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a within the time that both streams of a key cover."""
    span = lambda df, n: df.groupBy(key).agg(F.min("t").alias(f"_lo{n}"), F.max("t").alias(f"_hi{n}"))
    both = span(a, 0).join(span(b, 1), key)
    return a.join(both, key).where((F.col("t") >= F.greatest("_lo0", "_lo1")) & (F.col("t") <= F.least("_hi0", "_hi1"))).select(*a.columns)


def latest(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct("t", *fields), F.struct("t", *fields)).alias("m")).select(key, "m.*")


def last_overlap(frames: DataFrame, key: str, half: float, reach: int) -> DataFrame:
    """For each frame the last one, without a gap, whose box (place p +- half) touches its own, looking `reach` ahead.

    Frames have running numbers idx; those ahead are joined by number, never all with all.
    """
    ahead = frames.select(key, F.col("idx").alias("_i"), F.col("p").alias("_p"))
    near = frames.withColumn("_i", F.explode(F.sequence(F.col("idx"), F.col("idx") + reach)))
    miss = near.join(ahead, [key, "_i"], "left").withColumn("_m", F.when(F.col("_p").isNull() | (F.abs(F.col("p") - F.col("_p")) > 2 * half), F.col("_i")))
    return miss.groupBy(key, "idx").agg(F.coalesce(F.min("_m") - 1, F.col("idx") + reach).alias("last_idx"))


#: Frames of a block, and children of a node above the blocks.
FAN = 256


def last_overlap_any(frames: DataFrame, key: str, half: float) -> DataFrame:
    """last_overlap without an end to the look-ahead, for running numbers idx without gaps.

    Frames come together in blocks of FAN, where numpy finds the first frame of the rest of the block that each does not overlap. What
    overlaps all the rest asks further: least and greatest places of FAN, FAN * FAN, ... frames lie in arrays of FAN
    nodes, and an ask reads one array a level, upwards until a node fails and down to the first frame that fails. A
    frame is one row all the way, in steps logarithmic in the run's length; runs of one block are shuffled once.
    """
    frames = written(frames.select(key, F.col("idx").cast("long").alias("idx"), F.col("p").cast("double").alias("p")), "frames")
    most = frames.agg(F.max("idx")).first()[0] or 0
    of = lambda nodes: nodes.groupBy(key, F.floor(F.col("_k") / FAN).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_k", "_lo", "_hi", "_all"))).alias("_nodes"))
    nodes = frames.select(key, F.col("idx").alias("_k"), F.col("p").alias("_lo"), F.col("p").alias("_hi"), F.col("p").isNotNull().alias("_all"))
    levels = [of(nodes)]
    while FAN ** len(levels) <= most:
        nodes = nodes.groupBy(key, F.floor(F.col("_k") / FAN).alias("_k")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_all").alias("_all"))
        levels.append(of(nodes))

    def in_blocks(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            at, inner = lists.offsets.to_numpy(), lists.values
            idx, p = inner.field("_k").to_numpy(), inner.field("_lo").to_numpy(zero_copy_only=False)
            miss, end = np.full(len(idx), -1), np.zeros(len(idx), np.int64)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                with np.errstate(invalid="ignore"):
                    apart = np.triu(~(np.abs(p[i:j] - p[i:j, None]) <= 2 * half))
                first = apart.argmax(1)
                miss[i:j], end[i:j] = np.where(apart[np.arange(j - i), first], idx[i:j][first], -1), idx[j - 1]
            found = pa.StructArray.from_arrays([inner.field("_k"), inner.field("_lo"), pa.array(miss, mask=miss < 0), pa.array(end)], names=["idx", "p", "_s", "_end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(lists.offsets, found)], names=[key, "_f"])

    kind = frames.schema[key].dataType.simpleString()
    own = levels[0].select(key, "_nodes").mapInArrow(in_blocks, f"`{key}` {kind}, _f array<struct<idx: long, p: double, _s: long, _end: long>>").select(key, F.explode("_f").alias("_f")).select(key, "_f.*")
    if len(levels) == 1:
        return own.select(key, "idx", F.coalesce(F.col("_s") - 1, "_end").alias("last_idx"))
    own = written(own.drop("_end"), "blocks")
    overlaps = lambda c: F.coalesce(c["_all"] & (c["_hi"] - F.col("p") <= 2 * half) & (F.col("p") - c["_lo"] <= 2 * half), F.lit(False))

    def met(rows: DataFrame, level: int, at: Column) -> DataFrame:
        """rows with _m: the first node of an array, from _s on, that does not overlap whole."""
        near = rows.withColumn("_at", at).join(levels[level], [key, "_at"], "left")
        return near.withColumn("_m", F.get(F.filter("_nodes", lambda c: (c["_k"] >= F.col("_s")) & ~overlaps(c)), F.lit(0))["_k"]).drop("_at", "_nodes")

    # _s: the first node that is not yet known to overlap; apart[level]: frames whose first failing node is of that level.
    apart, rows = [own.where("_s is not null")], own.where("_s is null").withColumn("_s", F.floor(F.col("idx") / FAN) + 1)
    for level in range(1, len(levels)):
        asked = met(rows, level, F.floor(F.col("_s") / FAN))
        apart.append(asked.where("_m is not null").withColumn("_s", F.col("_m")).drop("_m"))
        rows = asked.where("_m is null").withColumn("_s", F.floor(F.col("_s") / FAN) + 1).drop("_m")
    below = apart[-1]
    for level in range(len(levels) - 2, -1, -1):
        found = met(below.withColumnRenamed("_s", "_p").withColumn("_s", F.col("_p") * FAN), level, F.col("_p"))
        below = found.withColumn("_s", F.col("_m")).drop("_m", "_p").unionByName(apart[level])
    ends = frames.groupBy(key).agg(F.max("idx").alias("_end"))
    return below.select(key, "idx", (F.col("_s") - 1).alias("last_idx")).unionByName(rows.join(ends, key).select(key, "idx", F.col("_end").alias("last_idx")))


def before_run(rows: DataFrame, key: str, bad: Column, longest: int, slice_us: int = DAY) -> DataFrame:
    """Rows before the key's first run of `longest` bad ones in a row is whole."""
    streak = {"_b": lambda w: F.sum(bad.cast("int")).over(w.rowsBetween(-(longest - 1), 0)) >= longest, "_i": lambda w: F.col("_k")}
    at = looking_back(rows, key, longest - 1, streak, slice_us)
    stops = at.where("_b").groupBy(F.col(key).alias("_key")).agg(F.min("_i").alias("_stop"))
    met = at.join(stops, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.where("_stop is null or _i < _stop").select(*rows.columns)


def trailing(rows: DataFrame, key: str, value: str, n: int, slice_us: int = DAY) -> DataFrame:
    """Mean of the n rows before each, and the key's first value."""
    at = looking_back(rows, key, n, {"context_mean": lambda w: F.avg(value).over(w.rowsBetween(-n, -1)), "_i": lambda w: F.col("_k")}, slice_us)
    firsts = at.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(F.col(value).alias("v")), "_i").alias("_first"))
    return at.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, "context_mean", F.col("_first.v").alias("first_value"))


def frames_around(frames: DataFrame, key: str, back: int, ahead: int, step: int, fields: list[str]) -> DataFrame:
    """Rows (key, idx, other, fields): each frame with every step-th frame from idx - back to idx + ahead - 1; at most (back + ahead) / step a frame."""
    others = frames.select(key, F.col("idx").alias("other"), *(F.col(f).alias(f"_{f}") for f in fields))
    near = frames.select(key, "idx", F.explode(F.sequence(F.col("idx") - back, F.col("idx") + ahead - 1, F.lit(step).cast("long"))).alias("other"))
    return near.join(others, [key, "other"]).select(key, "idx", "other", *(F.col(f"_{f}").alias(f) for f in fields))
