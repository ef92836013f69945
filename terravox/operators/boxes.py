"""Boxes of a run's frames in any number of dimensions: which overlap, until when, and what a volume that moves with them holds.

A box has columns lo_<axis> and hi_<axis> and is closed: touching counts. Frames of a key have running numbers idx without
gaps. Asks and frames come together in blocks of FAN * FAN frames, where numpy finds the first frame of the rest of the block that an
ask does not meet. What meets all the rest asks further, in a tree: a node has the greatest lo and the least hi of FAN nodes below
it, on each axis, so that one comparison tells whether all its frames meet a box. Children of a node lie in one array; an ask
reads one node a level, so it is one row all the way, in steps logarithmic in the run's length.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.working import written

#: Children of a node.
FAN = 16
#: Pairs that numpy compares at a time.
PAIRS = 1 << 20
#: Rows that are given back at a time, at least.
ROWS = 1 << 16
#: Frames whose asks for one slice of time come together.
ASKING = 4096


def _ends(axes: tuple[str, ...]) -> list[str]:
    return [f"{e}_{a}" for a in axes for e in ("lo", "hi")]


def _together(asks: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, _asks, _others): the rows of both sides with the same keys (nulls alike), in arrays."""
    side = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys[1:])).alias(name))
    both = side(asks, "_a").unionByName(side(others, "_o"), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.collect_list("_a").alias("_asks"), F.collect_list("_o").alias("_others"))


def _columns(rows, names: list[str]):
    """Columns of an array of structs for numpy (null: 0), and whether none is null."""
    import numpy as np
    import pyarrow.compute as pc

    known = np.ones(len(rows), bool)
    for n in names:
        known &= pc.is_valid(rows.field(n)).to_numpy(zero_copy_only=False)
    return {n: pc.fill_null(rows.field(n), 0).to_numpy(zero_copy_only=False) for n in names}, known


def _pieces(asks, others):
    """(slice of asks, slice of others) of each row, the asks in pieces of at most about PAIRS pairs."""
    for i, j, k, m in zip(asks[:-1].tolist(), asks[1:].tolist(), others[:-1].tolist(), others[1:].tolist(), strict=True):
        step = max(1, PAIRS // max(1, m - k))
        for first in range(i, j, step):
            yield slice(first, min(first + step, j)), slice(k, m)


def _apart_in_blocks(asks: DataFrame, frames: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """asks with _m: the first frame of their block, from the ask's idx on, whose box does not meet theirs."""
    size, ends = FAN * FAN, _ends(axes)
    block = F.floor(F.col("idx") / size).alias("_block")
    nodes = frames.select(key, block, F.col("idx").cast("long").alias("idx"), *ends)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, other = batch.column(1), batch.column(2)
            (a, a_known), (n, n_known) = (_columns(x.values, ["idx", *ends]) for x in (lists, other))
            miss = np.full(len(lists.values), -1)
            for own, near in _pieces(lists.offsets.to_numpy(), other.offsets.to_numpy()):
                order = np.argsort(n["idx"][near]) + near.start
                if not len(order):
                    continue
                meets = a_known[own, None] & n_known[order]
                for x in axes:
                    meets &= (n[f"lo_{x}"][order] <= a[f"hi_{x}"][own, None]) & (a[f"lo_{x}"][own, None] <= n[f"hi_{x}"][order])
                apart = ~meets & (n["idx"][order] >= a["idx"][own, None])
                first = apart.argmax(1)
                miss[own] = np.where(apart[np.arange(len(first)), first], n["idx"][order[first]], -1)
            inner = lists.values
            names = [f.name for f in inner.type]
            found = pa.StructArray.from_arrays([*(inner.field(c) for c in names), pa.array(miss, mask=miss < 0)], names=[*names, "_m"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lists.offsets, found)], names=["_f"])

    dealt = _together(asks.withColumn("_block", block), nodes, [key, "_block"]).select(key, "_asks", "_others")
    kept = T.StructType([*(f for f in asks.schema.fields), T.StructField("_m", T.LongType())])
    return dealt.mapInArrow(run, T.StructType([T.StructField("_f", T.ArrayType(kept))])).select(F.explode("_f").alias("_f")).select("_f.*")


def _tree(frames: DataFrame, key: str, axes: tuple[str, ...]) -> list[DataFrame]:
    """Levels of rows (_key, _parent, _children), from frames upwards."""
    known = reduce(and_, (F.col(f"{e}_{a}").isNotNull() for a in axes for e in ("lo", "hi")))
    nodes = frames.select(F.col(key).alias("_key"), F.col("idx").alias("_k"), *(F.col(f"{e}_{a}") for a in axes for e in ("lo", "hi")), known.alias("_whole"))
    last, levels = frames.agg(F.max("idx")).first()[0] or 0, []
    while True:
        kept = F.struct("_k", *(f"{e}_{a}" for a in axes for e in ("lo", "hi")), "_whole")
        levels.append(nodes.groupBy("_key", F.floor(F.col("_k") / FAN).alias("_parent")).agg(F.array_sort(F.collect_list(kept)).alias("_children")))
        if FAN ** len(levels) > last:
            return levels
        ends = [f(f"{e}_{a}").alias(f"{e}_{a}") for a in axes for e, f in (("lo", F.max), ("hi", F.min))]
        nodes = nodes.groupBy("_key", F.floor(F.col("_k") / FAN).alias("_k")).agg(*ends, F.bool_and("_whole").alias("_whole"))


def first_apart(asks: DataFrame, frames: DataFrame, key: str, axes: tuple[str, ...], name: str = "until") -> DataFrame:
    """asks with the number of the first frame, from the ask's idx on, whose box does not meet the ask's; null where all do.

    A frame without a box meets none; an ask without a box meets none.
    """
    found = _apart_in_blocks(asks, frames, key, axes)
    most = frames.agg(F.max("idx")).first()[0] or 0
    if most < FAN * FAN:
        return found.withColumnRenamed("_m", name)
    found = written(found, "apart")
    levels = _tree(frames, key, axes)
    meets = lambda c: F.coalesce(c["_whole"] & reduce(and_, ((c[f"lo_{a}"] <= F.col(f"hi_{a}")) & (F.col(f"lo_{a}") <= c[f"hi_{a}"]) for a in axes)), F.lit(False))

    def met(rows: DataFrame, level: int, parent: Column) -> DataFrame:
        """rows with _m: the first child, from _s on, that does not meet."""
        at = rows.withColumn("_at", parent).join(levels[level], F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_parent")), "left")
        first = F.get(F.filter("_children", lambda c: (c["_k"] >= F.col("_s")) & ~meets(c)), F.lit(0))
        return at.withColumn("_m", first["_k"]).drop("_at", "_key", "_parent", "_children")

    # _s: the first node that is not yet known to meet; apart[level]: asks whose first failing node is of that level.
    apart: list[DataFrame | None] = [found.where("_m is not null").withColumnRenamed("_m", "_s"), None]
    rows = found.where("_m is null").drop("_m").withColumn("_s", F.floor(F.col("idx") / (FAN * FAN)) + 1)
    for level in range(2, len(levels)):
        asked = met(rows, level, F.floor(F.col("_s") / FAN))
        apart.append(asked.where("_m is not null").withColumn("_s", F.col("_m")).drop("_m"))
        rows = asked.where("_m is null").withColumn("_s", F.floor(F.col("_s") / FAN) + 1).drop("_m")
    below = apart[-1]
    for level in range(len(levels) - 2, -1, -1):
        down = met(below.withColumn("_p", F.col("_s")).withColumn("_s", F.col("_s") * FAN), level, F.col("_p"))
        below = down.withColumn("_s", F.col("_m")).drop("_m", "_p")
        below = below if apart[level] is None else below.unionByName(apart[level])
    none = rows.withColumn("_s", F.lit(None).cast("long"))
    return below.unionByName(none).withColumnRenamed("_s", name)


def last_overlap(frames: DataFrame, key: str, axes: tuple[str, ...]) -> DataFrame:
    """Rows (key, idx, last_idx): for each frame the last one, without a gap, whose box meets its own; itself where it has no box."""
    ends = frames.groupBy(F.col(key).alias("_run")).agg(F.max("idx").alias("_end"))
    found = first_apart(frames, frames, key, axes).join(ends, F.col(key).eqNullSafe(F.col("_run")))
    return found.select(key, "idx", F.greatest("idx", F.coalesce(F.col("until") - 1, F.col("_end"))).alias("last_idx"))


def remembered(seen: DataFrame, volumes: DataFrame, key: str, axes: tuple[str, ...], features: list[str]) -> DataFrame:
    """seen (key, idx, g<axis>, features) as a volume that moves with the frames holds it after each: hits, first_idx, latest features, and until.

    A cell that a volume leaves out is forgotten; what is seen of it later starts anew. `until` is the first frame without
    it, null to the end: rows of a cell between two such frames share it, and are one stretch. A cell outside its own frame's volume
    is never held. One row a frame and cell is expected of seen.
    """
    point = {f"{e}_{a}": F.col(f"g{a}") for a in axes for e in ("lo", "hi")}
    until = first_apart(seen.withColumns(point), volumes, key, axes).drop(*point).where("until is null or until > idx")
    stretch = Window.partitionBy(key, *(f"g{a}" for a in axes), "until").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = {f: F.last(f, ignorenulls=True).over(stretch) for f in features}
    return until.withColumns({**kept, "hits": F.count(F.lit(1)).over(stretch), "first_idx": F.min("idx").over(stretch)})


def supervision(frames: DataFrame, seen: DataFrame, volumes: DataFrame, key: str, axes: tuple[str, ...], features: list[str], touching: DataFrame | None = None, slice_frames: int = 256) -> DataFrame:
    """Rows (key, idx, g<axis>, hits, first_idx, features): what the volume holds of each frame's cells after the last frame that overlaps it.

    frames and volumes: key, idx and the first and last cell on each axis; touching: boxes whose overlap counts, those of
    frames unless given (cells that share an edge need a box of one more). A row that the volume holds counts from its frame to
    the cell's next one, or until it is forgotten. Such stretches are dealt to the slices of frames that they reach into: at most the
    volume's cells go on from a slice to the next. A frame is one ask in the slice of its last_idx, where numpy finds its cells.
    """
    cell, ends, kept = [f"g{a}" for a in axes], _ends(axes), ["hits", "first_idx", *features]
    last = last_overlap(frames if touching is None else touching, key, axes)
    at = lambda c: F.floor(c / slice_frames)
    asks = frames.join(last, [key, "idx"]).select(key, at(F.col("last_idx")).alias("_at"), F.floor(F.col("idx") / ASKING).alias("_part"), F.col("idx").cast("long").alias("idx"), F.col("last_idx").cast("long").alias("_t"), *ends)
    asks = written(asks, "asks")
    held = remembered(seen, volumes, key, axes, features)
    following = F.lead("idx").over(Window.partitionBy(key, *cell, "until").orderBy("idx"))
    held = held.withColumn("_end", F.least(following, "until") - 1)
    to = asks.groupBy(key).agg(F.max("_t").alias("_last"))
    held = held.join(to, key).withColumn("_end", F.coalesce(F.least("_end", "_last"), "_last")).where("_end >= idx")
    dealt = held.withColumn("_at", F.explode(F.sequence(at(F.col("idx")), at(F.col("_end"))))).join(asks.select(key, "_at", "_part").distinct(), [key, "_at"])
    dealt = dealt.select(key, "_at", "_part", F.col("idx").cast("long").alias("_t"), F.col("_end").cast("long").alias("_end"), *cell, *kept)
    both = _together(asks, dealt, [key, "_at", "_part"])
    schema = T.StructType([T.StructField(c, (asks if c == "idx" else dealt).schema[c].dataType) for c in (key, "idx", *cell, *kept)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, other = batch.column(0), batch.column(1)
            (a, a_known), (n, _) = _columns(lists.values, ["idx", "_t", *ends]), _columns(other.values, ["_t", "_end", *cell])
            found, rows = [], 0

            def made():
                i, j = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                left, right = lists.values, other.values
                return pa.RecordBatch.from_arrays([*(left.field(c).take(i) for c in (key, "idx")), *(right.field(c).take(j) for c in (*cell, *kept))], names=[key, "idx", *cell, *kept])

            for own, near in _pieces(lists.offsets.to_numpy(), other.offsets.to_numpy()):
                t = a["_t"][own, None]
                inside = a_known[own, None] & (n["_t"][near] <= t) & (n["_end"][near] >= t)
                for x in axes:
                    inside &= (n[f"g{x}"][near] >= a[f"lo_{x}"][own, None]) & (n[f"g{x}"][near] <= a[f"hi_{x}"][own, None])
                i, j = np.divmod(np.flatnonzero(inside), max(1, inside.shape[1]))
                found.append((i + own.start, j + near.start))
                rows += len(i)
                if rows >= ROWS:
                    yield made()
                    found, rows = [], 0
            if rows:
                yield made()

    return both.select("_asks", "_others").mapInArrow(run, schema)
