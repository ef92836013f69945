"""Neighbourhood operators on map cells (i, j).

A stencil is one scatter: each cell adds its weighted values to its targets, a tap at offset 0 carries the cell's own
layers along, and one aggregation by target (with partial sums before the shuffle) ends it. No self-join is needed, so
iterated stencils have plans that grow by one step a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Kernel, kernel
from ..sources.working import written


def scatter_each(cells: DataFrame, sums: dict[str, tuple[Kernel, Column]]) -> DataFrame:
    """Cells with, for each of sums, the total of weight * value over its own taps, all in one shuffle; absent neighbours count as nothing."""
    own = [c for c in cells.columns if c not in ("i", "j")]
    weights: dict[tuple[int, int], dict[str, float]] = {(0, 0): {}}
    for k, (taps, _) in sums.items():
        for di, dj, w in taps:
            weights.setdefault((di, dj), {})[k] = w
    entry = lambda at, w: F.struct(F.lit(at[0]).alias("di"), F.lit(at[1]).alias("dj"), *(F.lit(float(w.get(k, 0.0))).alias(f"w{n}") for n, k in enumerate(sums)))
    spread = cells.withColumns({f"_{k}": v for k, (_, v) in sums.items()}).withColumn("_t", F.explode(F.array(*(entry(at, w) for at, w in sorted(weights.items())))))
    here = (F.col("_t.di") == 0) & (F.col("_t.dj") == 0)
    to = spread.withColumns({"i": F.col("i") - F.col("_t.di"), "j": F.col("j") - F.col("_t.dj"), "_here": here})
    parts = (F.sum(F.col(f"_t.w{n}") * F.col(f"_{k}")).alias(k) for n, k in enumerate(sums))
    out = to.groupBy("i", "j").agg(F.max(F.col("_here").cast("int")).alias("_cell"), *(F.max(F.when(F.col("_here"), F.col(c))).alias(c) for c in own), *parts)
    return out.where("_cell = 1").drop("_cell")


def scatter(cells: DataFrame, taps: Kernel, sums: dict[str, Column]) -> DataFrame:
    """scatter_each with the same taps for all sums."""
    return scatter_each(cells, {k: (taps, v) for k, v in sums.items()})


def elevation_filter(cells: DataFrame, layer: str, mask: Column, taps: Kernel, low: float, high: float) -> DataFrame:
    """Known cells whose height differs from their neighbours' mean by more than the limits become unknown."""
    around = [t for t in taps if t[:2] != (0, 0)]
    known = cells.withColumn("_m", mask.cast("double"))
    near = scatter(known, around, {"_v": F.col(layer) * F.col("_m"), "_c": F.col("_m")})
    diff = F.col(layer) - F.col("_v") / F.nullif(F.col("_c"), F.lit(0.0))
    valid = (F.col("_m") > 0) & (F.col("_c").isNull() | (F.col("_c") == 0) | ((diff > low) & (diff < high)))
    return near.withColumns({f"{layer}_filtered_mask": valid.cast("double"), f"{layer}_filtered": F.when(valid, F.col(layer)).otherwise(0.0)}).drop("_m", "_v", "_c")


def inflate(cells: DataFrame, layer: str, mask: str, taps: Kernel, threshold: float) -> DataFrame:
    """Unknown cells with enough known weight around get its mean; the mask is that density test for all cells."""
    total = sum(w for *_, w in taps)
    near = scatter(cells, taps, {"_v": F.col(layer) * F.col(mask), "_c": F.col(mask)})
    dense = F.col("_c") > threshold * total
    return near.withColumns({f"{layer}_inflated": F.when((F.col(mask) <= 0) & dense, F.col("_v") / F.col("_c")).otherwise(F.col(layer)), f"{layer}_inflated_mask": dense.cast("double")}).drop("_v", "_c")


def smooth(cells: DataFrame, layer: str, mask: str, taps: Kernel, rounds: int, alpha: float, beta: float, rate: float, out: str = "terrain") -> DataFrame:
    """Gradient steps of a Markov random field: heights stay near the readings and near their neighbours' mean."""
    taps = [t for t in taps if t[:2] != (0, 0)]
    state = cells.withColumn(out, F.col(layer))
    for _ in range(rounds):
        near = scatter(state, taps, {"_v": F.col(out) * F.col(mask), "_c": F.col(mask)})
        pull = alpha * (F.col(layer) - F.col(out)) + beta * (F.col("_v") - F.col("_c") * F.col(out)) / (F.col("_c") + 1e-8)
        state = near.withColumn(out, F.when(F.col(mask) > 0, F.col(out) + rate * pull).otherwise(F.col(out))).drop("_v", "_c")
    return state


def slope(cells: DataFrame, layer: str, mask: str, kind: str, radius: float, resolution: float, most: float = 1e10) -> DataFrame:
    """Gradient per metre where the whole window is known, each component held to +-most, and its size."""
    dx, dy = (dict(((i, j), w) for i, j, w in kernel(f"{kind}_{a}", radius, resolution)) for a in "xy")
    size = 3 if kind == "scharr" else 2 * round(radius / resolution) + 1
    half = size // 2
    window = [(i, j, 1.0) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    taps = lambda d: [(i, j, w) for (i, j), w in d.items()]
    near = scatter_each(cells, {"_x": (taps(dx), F.col(layer)), "_y": (taps(dy), F.col(layer)), "_n": (window, F.col(mask))})
    valid = F.col("_n") / (size * size) > 0.9999
    held = lambda c: F.when(valid, F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c) / resolution))).otherwise(0.0)
    return near.withColumns({"slope_x": held("_x"), "slope_y": held("_y")}).withColumn("slope", F.hypot("slope_x", "slope_y")).drop("_x", "_y", "_n")


def normals(cells: DataFrame, mask: str | None = None) -> DataFrame:
    """Unit normals of the slopes; zero where unknown."""
    size = F.sqrt(1 + F.col("slope_x") ** 2 + F.col("slope_y") ** 2)
    known = F.lit(True) if mask is None else F.col(mask) > 0
    return cells.withColumns({f"normal_{a}": F.when(known, c / size).otherwise(0.0) for a, c in (("x", -F.col("slope_x")), ("y", -F.col("slope_y")), ("z", F.lit(1.0)))})


def adjacencies(cells: DataFrame, layer: str) -> DataFrame:
    """The four neighbours' values; beyond the edge a cell's own."""
    ways = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
    values = {name: ([(*at, 1.0)], F.col(layer)) for name, at in ways.items()}
    near = scatter_each(cells, values | {f"_k_{name}": ([(*at, 1.0)], F.lit(1.0)) for name, at in ways.items()})
    return near.withColumns({name: F.when(F.col(f"_k_{name}") > 0, F.col(name)).otherwise(F.col(layer)) for name in ways}).drop(*(f"_k_{name}" for name in ways))


def closed(cells: DataFrame, inside: Column, out: str = "closed") -> DataFrame:
    """Binary closing by a cross of five cells: dilation, then erosion, to which cells beyond the map are outside."""
    cross = [(0, 0, 1.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)]
    wide = scatter(cells.withColumn("_m", inside.cast("double")), cross, {"_d": F.col("_m")}).withColumn("_d", (F.col("_d") > 0).cast("double"))
    return scatter(wide, cross, {"_e": F.col("_d")}).withColumn(out, F.col("_e") > 4.5).drop("_m", "_d", "_e")


#: Columns that one task takes through an envelope, and rows of a tile of them.
WIDE, TALL = 16, 4096


def envelope(places: list[int], heights: list[int]) -> tuple[list[int], list[int]]:
    """Of parabolas (i - place)^2 + height, by rising place: which are least anywhere, and from which whole i on each is.

    One pass: a new parabola takes from the last one all beyond where they meet, and the last goes if that is all it had.
    """
    kept: list[int] = []
    begin: list[int] = []
    for n, (q, h) in enumerate(zip(places, heights, strict=True)):
        start = None
        while kept:
            k = kept[-1]
            p = places[k]
            start = (h + q * q - heights[k] - p * p) // (2 * (q - p)) + 1
            if len(kept) == 1 or start > begin[-1]:
                break
            kept.pop()
            begin.pop()
        kept.append(n)
        begin.append(start)
    return kept, begin


def _envelopes(table):
    """Arrow group of sites (kind, j, k, h): those left of each column, with the first row from which each is nearest (null: from the first)."""
    import pyarrow as pa

    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "j", "k", "h")), strict=True))
    out: list[tuple] = []
    lo = 0
    while lo < len(rows):
        hi = lo
        while hi < len(rows) and rows[hi][:2] == rows[lo][:2]:
            hi += 1
        kept, begin = envelope([r[2] for r in rows[lo:hi]], [r[3] for r in rows[lo:hi]])
        out.extend((*rows[lo + n], s) for n, s in zip(kept, begin, strict=True))
        lo = hi
    kinds = pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "j", "k", "h", "start"])


def signed_distance(cells: DataFrame, inside: Column, resolution: float, tall: int = TALL) -> DataFrame:
    """Exact Euclidean distance to the mask of a dense map, positive outside and negative inside; null where all cells are of one kind.

    Each cell's gap to the nearest cell of either kind in its row comes from running windows. A column's distances are then
    the lower envelope of parabolas at its rows: tiles of `tall` rows reduce their own parabolas to those that can be least, a
    column's tiles put theirs together, and each tile gets those that are least somewhere in it. A cell takes the last that
    begins at or before it, so the second step gives one row a cell, and its work grows with the number of cells.
    """
    marked = cells.select("i", "j", inside.alias("m"))
    left, right = Window.partitionBy("i").orderBy("j"), Window.partitionBy("i").orderBy(F.col("j").desc())
    gap = lambda kind: F.least(*(F.abs(F.col("j") - F.last(F.when(F.col("m") == kind, F.col("j")), ignorenulls=True).over(w)) for w in (left, right)))
    rows = marked.withColumns({"to_in": gap(True), "to_out": gap(False)})
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("g")) for kind, c in ((True, "to_in"), (False, "to_out")))))
    sites = rows.select("i", "j", kinds.alias("_s")).where("_s.g is not null").select("_s.kind", F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("k"), (F.col("_s.g").cast("long") ** 2).cast("long").alias("h"))
    block, shape = F.floor(F.col("j") / WIDE).alias("_wide"), "kind boolean, j long, k long, h long, start long"
    own = sites.groupBy("kind", block, F.floor(F.col("k") / tall).alias("_tall")).applyInArrow(_envelopes, shape)
    least = own.select("kind", "j", "k", "h").groupBy("kind", block).applyInArrow(_envelopes, shape)
    low, high = (v or 0 for v in marked.agg(F.min("i"), F.max("i")).first())
    tile = lambda c: F.floor(c / tall)
    following = F.lead("start").over(Window.partitionBy("kind", "j").orderBy("k"))
    span = least.withColumn("_from", F.greatest(F.coalesce("start", F.lit(low)), F.lit(low))).withColumn("_to", F.least(F.coalesce(following - 1, F.lit(high)), F.lit(high))).where("_from <= _to")
    dealt = span.withColumn("_tall", F.explode(F.sequence(tile(F.col("_from")), tile(F.col("_to"))))).select("kind", "j", "_tall", F.greatest("_from", F.col("_tall") * tall).alias("i"), F.lit(0).alias("_side"), F.struct("k", "h").alias("_site"))
    asked = marked.select((~F.col("m")).alias("kind"), F.col("j").cast("long").alias("j"), tile(F.col("i")).alias("_tall"), F.col("i").cast("long").alias("i"), F.lit(1).alias("_side"))
    down = Window.partitionBy("kind", "j", "_tall").orderBy("i", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(dealt, allowMissingColumns=True).withColumn("_site", F.last("_site", ignorenulls=True).over(down)).where("_side = 1")
    far = F.sqrt((F.col("i") - F.col("_site.k")) ** 2 + F.col("_site.h")) * resolution
    back = {c: F.col(c).cast(cells.schema[c].dataType) for c in ("i", "j")}
    return found.select(*(v.alias(c) for c, v in back.items()), F.when(F.col("kind"), far).otherwise(-far).alias("sdf"))


def distance_to(cells: DataFrame, poses: DataFrame, x: Column, y: Column, reach: float, bound: float) -> DataFrame:
    """Distance of each cell to the nearest pose within reach, or `bound` where none is.

    Poses and cells meet in squares of side reach: a cell looks into its own square and the eight around it.
    """
    square = lambda c: F.floor(c / reach).cast("long")
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    at = cells.withColumns({"_x": x, "_y": y}).withColumn("_o", F.explode(around))
    at = at.withColumns({"_sx": square(F.col("_x")) + F.col("_o.a"), "_sy": square(F.col("_y")) + F.col("_o.b")})
    ours = poses.select(F.col("px"), F.col("py"), square(F.col("px")).alias("_sx"), square(F.col("py")).alias("_sy"))
    met = at.join(ours, ["_sx", "_sy"], "left").groupBy("i", "j").agg(F.min(F.hypot(F.col("_x") - F.col("px"), F.col("_y") - F.col("py"))).alias("d"))
    return met.select("i", "j", F.when(F.col("d") <= reach, F.col("d")).otherwise(bound).alias("distance"))


#: Poses that a square of the tree holds at most, how many times as wide its parent is, and levels below the first squares at most.
LEAF, WIDER, DEEPEST = 64, 4, 20


def _square(c: str, side: float, level: int) -> Column:
    return F.floor(F.col(c) / (side * float(WIDER) ** level)).cast("long")


def quadtree(poses: DataFrame, side: float, leaf: int = LEAF) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Boxes around poses in squares of `side`, and of wider ones up to a few; squares that hold more than `leaf` poses are cut until none does.

    Gives squares from the few largest down to `side`, then those of cut ones level by level (rows _sx, _sy, a box and
    whether the square is a leaf), and the poses of the leaves of each level from `side` on.
    """
    box = {"_x0": F.min("px"), "_x1": F.max("px"), "_y0": F.min("py"), "_y1": F.max("py")}
    at = lambda df, level: df.withColumns({f"_s{a}": _square(f"p{a}", side, level) for a in "xy"})
    fine, held, level = [], [], 0
    while True:
        squares = at(poses, level).groupBy("_sx", "_sy").agg(*(f.alias(k) for k, f in box.items()), F.count(F.lit(1)).alias("_n"))
        squares = written(squares.withColumn("_leaf", (F.col("_n") <= leaf) | F.lit(level == -DEEPEST)), f"squares-{-level}")
        fine.append(squares)
        mine = at(poses, level).join(squares.select("_sx", "_sy", "_leaf"), ["_sx", "_sy"])
        held.append(mine.where("_leaf").select("_sx", "_sy", "px", "py"))
        if squares.where("not _leaf").isEmpty():
            break
        poses, level = written(mine.where("not _leaf").select("px", "py"), f"dense-{-level}"), level - 1
    coarse, up = [fine[0]], {"_x0": F.min("_x0"), "_x1": F.max("_x1"), "_y0": F.min("_y0"), "_y1": F.max("_y1")}
    span = fine[0].agg(F.greatest(F.max("_sx") - F.min("_sx"), F.max("_sy") - F.min("_sy"))).first()[0] or 0
    while span // WIDER ** (len(coarse) - 1) > 1:
        coarse.append(coarse[-1].groupBy(F.floor(F.col("_sx") / WIDER).alias("_sx"), F.floor(F.col("_sy") / WIDER).alias("_sy")).agg(*(f.alias(k) for k, f in up.items())))
    return coarse[:0:-1], fine, held


def near_leaves(cells: DataFrame, tree: tuple[list[DataFrame], list[DataFrame], list[DataFrame]]) -> list[DataFrame]:
    """For each level of leaves, rows (i, j, _x, _y, _sx, _sy): the leaves that can hold a cell's nearest pose.

    From the few largest squares downwards a cell follows the boxes that can hold a nearer pose than the farthest corner of its best box.
    """
    coarse, fine, _ = tree
    gap = [F.greatest(F.col(f"_{a}0") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"_{a}1"), F.lit(0.0)) for a in "xy"]
    far = [F.greatest(F.abs(F.col(f"_{a}") - F.col(f"_{a}0")), F.abs(F.col(f"_{a}") - F.col(f"_{a}1"))) for a in "xy"]

    def near(rows: DataFrame) -> DataFrame:
        """A cell's squares that its best one does not rule out; _best is the least bound so far."""
        best = F.least(F.min(F.hypot(*far)).over(Window.partitionBy("i", "j")), F.col("_best"))
        return rows.withColumns({"_least": F.hypot(*gap), "_best": best}).where(F.col("_least") <= F.col("_best") * (1 + 1e-9)).select("i", "j", "_x", "_y", "_sx", "_sy", "_best", *(["_leaf"] if "_leaf" in rows.columns else []))

    def down(at: DataFrame, level: DataFrame) -> DataFrame:
        parent = {"_px": F.floor(F.col("_sx") / WIDER), "_py": F.floor(F.col("_sy") / WIDER)}
        return near(at.drop("_leaf").withColumnsRenamed({"_sx": "_px", "_sy": "_py"}).join(level.withColumns(parent), ["_px", "_py"]))

    levels = [*coarse, *fine]
    at = near(cells.withColumn("_best", F.lit(float("inf"))).crossJoin(F.broadcast(levels[0])))
    for level in levels[1 : len(coarse) + 1]:
        at = down(at, level)
    if len(fine) == 1:
        return [at]
    out = []
    for k in range(len(fine)):
        at = written(at if k == 0 else down(at.where("not _leaf"), fine[k]), f"near-{k}")
        out.append(at.where("_leaf"))
    # A bound that was found further down rules out leaves of the levels above.
    bound = out[0].select("i", "j", "_best")
    for part in out[1:]:
        bound = bound.unionByName(part.select("i", "j", "_best"))
    bound = written(bound.groupBy("i", "j").agg(F.min("_best").alias("_bound")), "bounds")
    return [_ruled(part, fine[k], bound, gap) for k, part in enumerate(out)]


def _ruled(part: DataFrame, squares: DataFrame, bound: DataFrame, gap: list[Column]) -> DataFrame:
    kept = part.join(bound, ["i", "j"]).join(squares.select("_sx", "_sy", "_x0", "_x1", "_y0", "_y1"), ["_sx", "_sy"])
    return kept.where(F.hypot(*gap) <= F.col("_bound") * (1 + 1e-9)).select("i", "j", "_x", "_y", "_sx", "_sy")


def nearest_distance(cells: DataFrame, poses: DataFrame, x: Column, y: Column, side: float, leaf: int = LEAF) -> DataFrame:
    """Distance of each cell to the nearest of all poses, however far; null without poses.

    Poses lie in the leaves of a quadtree that hold `leaf` poses at most, however dense they are, so a cell is compared
    with those of a few leaves. Squares are cut DEEPEST times at most: what then still shares one lies within side / 2^40.
    """
    poses = poses.select(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).where("px is not null and py is not null").distinct()
    tree = quadtree(written(poses, "poses"), side, leaf)
    at = cells.select("i", "j", x.alias("_x"), y.alias("_y"))
    met = [near.join(held, ["_sx", "_sy"]).groupBy("i", "j").agg(F.min(F.hypot(F.col("_x") - F.col("px"), F.col("_y") - F.col("py"))).alias("distance")) for near, held in zip(near_leaves(at, tree), tree[2], strict=True)]
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    return cells.select("i", "j").join(found.groupBy("i", "j").agg(F.min("distance").alias("distance")), ["i", "j"], "left")
