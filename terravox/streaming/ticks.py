"""Maps that follow a vehicle tick by tick, kept as keyed state of their tiles.

A tick is one scan with the pose at which it was taken: the box moves with the pose and drops what it leaves, rays that pass
through what was known add misses, the scan's cells are merged, and cells that rays mostly pass are culled. Cells count from the
frame's zero and are dealt to tiles of `side` x `side` columns, so a column is never split and a tile's tick is a function of
the tile, the pose, and what the sensor saw in its direction.

A tick becomes one message for each tile of its box and of one ring of tiles around it, which tells the tiles that the box has just
left. Messages carry the scan's cells in the tile and the range of each sensor bin that lies in the tile's direction.
`TickStream` keeps tiles in the state store of transformWithStateInPandas; `fold` runs the same steps over whole tables, tiles side by side
and each in the order of its ticks, with one tile in memory at a time.

Each tick names the one before it in its run (null: the first). A tile whose last tick is not that one has been out of the box in between and
starts anew. A tick that is not later than a tile's last is a repeat and changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..grid import AXES, GridMeta
from ..operators import temporal, voxel
from ..operators.rays import SensorModel, bins_of

MESSAGE = "run long, tx long, ty long, tick long, prev long, stamp double, low array<long>, sensor array<double>, bins array<int>, far array<double>, keys array<long>, values array<double>"
TILE = ("run", "tx", "ty")
#: Cells below and above zero that a column's keys leave room for, and bits of a key that tell heights.
ZERO, HEIGHT = 1 << 39, 40


@dataclass
class Tile:
    """Cells by rising key, one row of layers each."""

    keys: np.ndarray
    values: np.ndarray
    tick: int = -1
    #: First column of the box at that tick.
    low: tuple[int, int] = (0, 0)

    @staticmethod
    def empty(width: int) -> Tile:
        return Tile(np.zeros(0, np.int64), np.zeros((0, width)))


@dataclass(frozen=True)
class TickMap:
    """What is common to the maps: a box around the vehicle (base: its origin as seen from the pose), cells, tiles and messages."""

    base: GridMeta
    features: tuple[str, ...]
    alpha: float
    side: int = 16

    def low(self, pose: tuple[float, float, float]) -> list[int]:
        """First cell of the box on each axis."""
        return [int(self.snap(np.float64(p + o) / r)) for p, o, r in zip(pose, self.base.origin, self.base.resolution, strict=True)]

    def schema(self) -> str:
        return f"run long, tx long, ty long, tick long, low_x long, low_y long, gx long, gy long{', gz long' if len(self.axes) == 3 else ''}, {', '.join(f'{c} double' for c in self.layers)}"

    def column(self, gx, gy):
        """A column's number in its tile."""
        return gx % self.side * self.side + gy % self.side

    def cells(self, keys: np.ndarray, tx: int, ty: int) -> list[np.ndarray]:
        column = keys >> HEIGHT
        return [tx * self.side + column // self.side, ty * self.side + column % self.side, (keys & ((1 << HEIGHT) - 1)) - ZERO][: len(self.axes)]

    def inside(self, keys: np.ndarray, m) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for g, low, n in zip(self.cells(keys, m.tx, m.ty), m.low, self.base.n, strict=False):
            out &= (g >= low) & (g < low + n)
        return out

    def frame(self, run: int, tx: int, ty: int, tile: Tile) -> pd.DataFrame:
        """The tile's cells as rows; one row without a cell where it has none."""
        head = {"run": run, "tx": tx, "ty": ty, "tick": tile.tick, "low_x": tile.low[0], "low_y": tile.low[1]}
        if not len(tile.keys):
            return pd.DataFrame([head]).reindex(columns=self.names()).astype({f"g{a}": "Int64" for a in self.axes})
        return pd.DataFrame(head | dict(zip((f"g{a}" for a in self.axes), self.cells(tile.keys, tx, ty), strict=True)) | dict(zip(self.layers, tile.values.T, strict=True)))

    def names(self) -> list[str]:
        return ["run", "tx", "ty", "tick", "low_x", "low_y", *(f"g{a}" for a in self.axes), *self.layers]

    def apply(self, tile: Tile, m) -> tuple[Tile, bool]:
        """The tile after a message, and whether its cells have changed or the box begins in it."""
        if m.tick <= tile.tick:
            return tile, False
        had, low = len(tile.keys), (int(m.low[0]), int(m.low[1]))
        if tile.tick >= 0 and not (m.prev == tile.tick):
            tile = Tile.empty(len(self.layers))
        keep = self.inside(tile.keys, m)
        changed = had != len(tile.keys) or not keep.all() or (low[0] // self.side, low[1] // self.side) == (m.tx, m.ty)
        moved = Tile(tile.keys[keep], tile.values[keep], int(m.tick), low)
        if not len(moved.keys) and not len(m.keys):
            return moved, changed
        after = self.step(moved, m)
        return Tile(*after, moved.tick, low), changed or not (np.array_equal(after[0], moved.keys) and np.array_equal(after[1], moved.values, equal_nan=True))

    # Messages

    def messages(self, scans: DataFrame) -> DataFrame:
        """Messages of scans (run, tick, prev, stamp, px, py, pz, points: array of x, y, z and features), one scan at a time; a stream or a table.

        A scan without points moves the box and lets rays pass.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for scan in batch.itertuples(index=False):
                    yield self._spread(scan)

        numbers = lambda c: F.transform("points", lambda p: F.coalesce(p[c].cast("double"), F.lit(float("nan")))).alias(c)
        kept = scans.select(F.col("run").cast("long").alias("run"), F.col("tick").cast("long").alias("tick"), F.col("prev").cast("long").alias("prev"), F.col("stamp").cast("double").alias("stamp"), *(F.col(f"p{a}").cast("double").alias(f"p{a}") for a in AXES), *(numbers(c) for c in (*AXES, *self.features)))
        return kept.mapInPandas(run, MESSAGE)

    def _spread(self, scan) -> pd.DataFrame:
        sensor = (scan.px, scan.py, scan.pz)
        points = np.array([np.asarray(getattr(scan, c) if getattr(scan, c) is not None else [], float) for c in (*AXES, *self.features)]).T
        low = self.low(sensor)
        bins, far = self.returns(points, sensor)
        g = np.floor(points[:, :3] / np.array(self.base.resolution)).astype(np.int64)
        inside = np.ones(len(g), bool)
        for k in range(len(self.axes)):
            inside &= (g[:, k] >= low[k]) & (g[:, k] < low[k] + self.base.n[k])
        columns, keys, values = self.gathered(g[inside], points[inside], sensor)
        tiles = columns // self.side
        rows = []
        for tx, ty in self.tiles(low):
            mine = (tiles[:, 0] == tx) & (tiles[:, 1] == ty)
            near = self.towards(bins, tx, ty, sensor)
            rows.append((scan.run, tx, ty, scan.tick, scan.prev, scan.stamp, low, sensor, bins[near], far[near], keys[mine], values[mine].ravel()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")]).astype({"prev": "Int64"})

    def tiles(self, low: list[int]) -> list[tuple[int, int]]:
        """Tiles of the box and of the ring around it."""
        spans = [range(low[k] // self.side - 1, (low[k] + self.base.n[k] - 1) // self.side + 2) for k in (0, 1)]
        return [(tx, ty) for tx in spans[0] for ty in spans[1]]

    def returns(self, points: np.ndarray, sensor) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int32), np.zeros(0)

    def towards(self, bins: np.ndarray, tx: int, ty: int, sensor) -> np.ndarray:
        return np.ones(len(bins), bool)

    # Running

    def fold(self, messages: DataFrame) -> DataFrame:
        """Cells after the last tick of all messages: tiles side by side, each in the order of its ticks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, tile = None, Tile.empty(len(self.layers))
            for batch in batches:
                for m in batch.itertuples(index=False):
                    if (m.run, m.tx, m.ty) != at:
                        if at is not None and len(tile.keys):
                            yield self.frame(*at, tile)
                        at, tile = (m.run, m.tx, m.ty), Tile.empty(len(self.layers))
                    tile, _ = self.apply(tile, m)
            if at is not None and len(tile.keys):
                yield self.frame(*at, tile)

        cells = messages.repartition(*TILE).sortWithinPartitions(*TILE, "tick").mapInPandas(run, self.schema()).drop("low_x", "low_y")
        # A tile without its run's last tick has been left behind by a jump.
        return cells.join(messages.groupBy("run").agg(F.max("tick").alias("tick")), ["run", "tick"], "left_semi")


def _fused(old: Tile, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys, and the rows of either side at them; NaN where a side has none."""
    both = np.union1d(old.keys, keys)
    a, b = (np.full((len(both), values.shape[1]), np.nan) for _ in range(2))
    a[np.searchsorted(both, old.keys)], b[np.searchsorted(both, keys)] = old.values, values
    return both, a, b


def _averaged(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, a * (1 - alpha) + b * alpha))


@dataclass(frozen=True)
class VoxelTicks(TickMap):
    """Voxels with hits, misses, bounds and times; features are those of the point nearest to the sensor, then a moving average."""

    model: SensorModel | None = None
    cull_share: float | None = 0.75
    no_return: float = 200.0
    drop_first: bool = True
    axes: tuple[str, ...] = field(default=AXES, init=False)
    snap = staticmethod(np.rint)

    @property
    def layers(self) -> tuple[str, ...]:
        return ("hits", "misses", *(f"{e}_{a}" for e in ("min", "max") for a in AXES), "first_update", "last_update", *self.features)

    def gathered(self, g: np.ndarray, points: np.ndarray, sensor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, key, bounds and features) of each voxel of a scan."""
        key = (self.column(g[:, 0], g[:, 1]) << HEIGHT) + g[:, 2] + ZERO
        known = ~np.isnan(points[:, 3]) if self.features else np.zeros(len(g), bool)
        far = np.where(known, ((points[:, :3] - sensor) ** 2).sum(1), np.inf)
        order = np.lexsort((far, key, g[:, 1] // self.side, g[:, 0] // self.side))
        g, key, far, points, known = g[order], key[order], far[order], points[order], known[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]).any(1))) if len(g) else np.zeros(0, int)
        if not len(first):
            return np.zeros((0, 2), np.int64), key, np.zeros((0, 6 + len(self.features)))
        size = np.diff(np.append(first, len(g)))
        best = known & (far == np.repeat(far[first], size))  # ties are averaged
        n = np.add.reduceat(best.astype(float), first)
        with np.errstate(invalid="ignore"):
            f = np.add.reduceat(np.where(best[:, None], points[:, 3:], 0.0), first) / n[:, None]
        return g[first, :2], key[first], np.hstack([np.minimum.reduceat(points[:, :3], first), np.maximum.reduceat(points[:, :3], first), f])

    def returns(self, points: np.ndarray, sensor) -> tuple[np.ndarray, np.ndarray]:
        if self.model is None or not len(points):
            return super().returns(points, sensor)
        at, r = bins_of(self.model, points[:, :3] - sensor)
        far = np.full(self.model.el[2] * self.model.az[2], -1.0)
        np.maximum.at(far, at[at >= 0], r[at >= 0])
        bins = np.flatnonzero(far >= 0)
        bins = bins[bins > 0] if self.drop_first else bins
        return bins.astype(np.int32), far[bins]

    def towards(self, bins: np.ndarray, tx: int, ty: int, sensor) -> np.ndarray:
        """Bins whose azimuth can hold a centre of the tile's voxels: those within the angle of a circle around the tile."""
        if self.model is None:
            return super().towards(bins, tx, ty, sensor)
        (lo, hi, n), (rx, ry) = self.model.az, self.base.resolution[:2]
        step = math.radians(hi - lo) / n
        dx, dy = (tx + 0.5) * self.side * rx - sensor[0], (ty + 0.5) * self.side * ry - sensor[1]
        around, away = math.hypot(rx, ry) * self.side / 2, math.hypot(dx, dy)
        half = math.pi if away <= around else math.asin(around / away) + step
        off = math.radians(lo) + (bins % n + 0.5) * step - math.atan2(dy, dx)
        return np.abs((off + math.pi) % (2 * math.pi) - math.pi) <= half

    def step(self, old: Tile, m) -> tuple[np.ndarray, np.ndarray]:
        if self.model is not None and len(old.keys):
            old = Tile(old.keys, old.values.copy())
            centres = [(g + 0.5) * r for g, r in zip(self.cells(old.keys, m.tx, m.ty), self.base.resolution, strict=True)]
            at, r = bins_of(self.model, np.stack(centres, 1) - np.asarray(m.sensor, float))
            far = np.full(self.model.el[2] * self.model.az[2], self.no_return)
            far[np.asarray(m.bins, np.int64)] = m.far
            old.values[:, 1] += (at >= 0) & (r < far[at])
        n = len(m.keys)
        fresh = np.asarray(m.values, float).reshape(n, 6 + len(self.features))
        fresh = np.hstack([np.ones((n, 1)), np.zeros((n, 1)), fresh[:, :6], np.full((n, 2), m.stamp), fresh[:, 6:]])
        order = np.argsort(np.asarray(m.keys, np.int64))
        keys, a, b = _fused(old, np.asarray(m.keys, np.int64)[order], fresh[order])
        out = np.hstack([np.nan_to_num(a[:, :2]) + np.nan_to_num(b[:, :2]), np.fmin(a[:, 2:5], b[:, 2:5]), np.fmax(a[:, 5:8], b[:, 5:8]), np.fmin(a[:, 8:9], b[:, 8:9]), np.fmax(a[:, 9:10], b[:, 9:10]), _averaged(a[:, 10:], b[:, 10:], self.alpha)])
        if self.cull_share is not None and len(keys):
            column = keys >> HEIGHT
            lowest = np.append(True, column[1:] != column[:-1])
            seen = out[:, 0] + out[:, 1]
            keep = lowest | (out[:, 1] <= self.cull_share * np.where(seen > 0, seen, 1.0))
            keys, out = keys[keep], out[keep]
        return keys, out

    def table_messages(self, points: DataFrame, poses: DataFrame) -> DataFrame:
        """Messages of whole tables: points (run, tick, x, y, z, features) and poses (run, tick, stamp, px, py, pz), voxelised by Spark.

        No scan passes through one task: a message holds a tile's voxels, which its cells bound.
        """
        heads = temporal.looking_back(poses.withColumn("t", F.col("tick")), "run", 1, {"prev": lambda w: F.lag("tick").over(w)}, slice_us=4096).drop("t")
        low = [F.rint((F.col(f"p{a}") + o) / r).cast("long") for a, o, r in zip(AXES, self.base.origin, self.base.resolution, strict=True)]
        heads = heads.select("run", "tick", "prev", F.col("stamp").cast("double").alias("stamp"), F.array(*low).alias("low"), F.array("px", "py", "pz").alias("sensor"))
        met = points.join(heads, ["run", "tick"])
        sensor, box = [F.col("sensor")[k] for k in range(3)], [F.col("low")[k] for k in range(3)]
        cell = {f"g{a}": F.floor(F.col(a) / r).cast("long") for a, r in zip(AXES, self.base.resolution, strict=True)}
        inside = met.withColumns(cell)
        for a, b, n in zip(AXES, box, self.base.n, strict=True):
            inside = inside.where((F.col(f"g{a}") >= b) & (F.col(f"g{a}") < b + n))
        voxels = voxel.bounds(inside, F.lit(0.0), ("run", "tick"))
        if self.features:
            local = inside.withColumns({a: F.col(a) - s for a, s in zip(AXES, sensor, strict=True)})
            voxels = voxels.join(voxel.nearest_features(local, list(self.features), (0.0, 0.0, 0.0), ("run", "tick")), ["run", "tick", "gx", "gy", "gz"], "left")
        row = F.array(*(F.col(f"{e}_{a}").cast("double") for e in ("min", "max") for a in AXES), *(F.coalesce(F.col(f), F.lit(float("nan"))) for f in self.features))
        gx, gy = F.pmod("gx", F.lit(self.side)), F.pmod("gy", F.lit(self.side))
        tile = lambda c: F.floor(c / self.side).cast("long")
        key = F.shiftleft((gx * self.side + gy).cast("long"), HEIGHT) + F.col("gz") + F.lit(ZERO)
        held = voxels.select("run", "tick", tile(F.col("gx")).alias("tx"), tile(F.col("gy")).alias("ty"), F.struct(key.alias("k"), row.alias("v")).alias("_v")).groupBy("run", "tick", "tx", "ty").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
        spread = heads
        for k, t in enumerate(("tx", "ty")):
            spread = spread.withColumn(t, F.explode(F.sequence(tile(box[k]) - 1, tile(box[k] + self.base.n[k] - 1) + 1)))
        if self.model is None:
            seen = spread.withColumns({"bins": F.array().cast("array<int>"), "far": F.array().cast("array<double>")})
        else:
            seen = self._facing(spread, self._ranges(met, sensor))
        none = F.array().cast("array<long>")
        out = seen.join(held, ["run", "tick", "tx", "ty"], "left")
        return out.select("run", "tx", "ty", "tick", "prev", "stamp", "low", "sensor", "bins", "far", F.coalesce(F.transform("_v", lambda s: s["k"]), none).alias("keys"), F.coalesce(F.flatten(F.transform("_v", lambda s: s["v"])), F.array().cast("array<double>")).alias("values"))

    def _ranges(self, met: DataFrame, sensor: list[Column]) -> DataFrame:
        """Rows (run, tick, _f): the farthest return of each bin; the sensor's bins bound the array."""
        from ..functions.geometry import to_spherical

        at = met.withColumns(to_spherical(*(F.col(a) - s for a, s in zip(AXES, sensor, strict=True)))).withColumn("bin", self.model.bin(F.col("el"), F.col("az")))
        kept = at.where("bin > 0" if self.drop_first else "bin >= 0").groupBy("run", "tick", "bin").agg(F.max("range").alias("far"))
        return kept.groupBy("run", "tick").agg(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), "far")).alias("_f"))

    def _facing(self, spread: DataFrame, ranges: DataFrame) -> DataFrame:
        """Tiles with the ranges of bins in their direction, as in towards()."""
        (lo, hi, n), (rx, ry) = self.model.az, self.base.resolution[:2]
        step, around = math.radians(hi - lo) / n, math.hypot(rx, ry) * self.side / 2
        dx, dy = ((F.col(t) + 0.5) * self.side * r - F.col("sensor")[k] for k, (t, r) in enumerate((("tx", rx), ("ty", ry))))
        away = F.hypot(dx, dy)
        half = F.when(away <= around, math.pi).otherwise(F.asin(F.least(F.lit(1.0), around / F.greatest(away, F.lit(1e-9)))) + step)
        met = spread.join(ranges, ["run", "tick"], "left").withColumns({"_to": F.atan2(dy, dx), "_half": half})
        off = lambda b: math.radians(lo) + (b["bin"] % n + 0.5) * step - F.col("_to") + math.pi
        near = F.filter("_f", lambda b: F.abs(off(b) - F.floor(off(b) / (2 * math.pi)) * (2 * math.pi) - math.pi) <= F.col("_half"))
        kept = met.withColumn("_f", F.coalesce(near, F.array().cast("array<struct<bin:int,far:double>>")))
        return kept.withColumns({"bins": F.transform("_f", lambda b: b["bin"]), "far": F.transform("_f", lambda b: b["far"])}).drop("_f", "_to", "_half")


@dataclass(frozen=True)
class BevTicks(TickMap):
    """Map cells: lowest and highest height with their hits, mean features as a moving average with theirs.

    Points above what is remembered of their cell by the overhang or more are left out. The box is snapped downwards.
    """

    overhang: float = 2.0
    cleanup: bool = True
    axes: tuple[str, ...] = field(default=("x", "y"), init=False)
    snap = staticmethod(np.floor)

    @property
    def layers(self) -> tuple[str, ...]:
        return ("min_elevation", "max_elevation", "num_points", "num_feature_points", *self.features)

    def gathered(self, g: np.ndarray, points: np.ndarray, sensor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, key, height and features) of each point: what counts hangs on what its tile remembers."""
        return g[:, :2], self.column(g[:, 0], g[:, 1]) << HEIGHT, points[:, 2:]

    def step(self, old: Tile, m) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.features)
        keys, points = np.asarray(m.keys, np.int64), np.asarray(m.values, float).reshape(len(m.keys), 1 + width)
        if len(old.keys):
            at = np.minimum(np.searchsorted(old.keys, keys), len(old.keys) - 1)
            known = (old.keys[at] == keys) & ~np.isnan(old.values[at, 0])
            below = ~known | (points[:, 0] < np.where(known, old.values[at, 0], np.inf) + self.overhang)
            keys, points = keys[below], points[below]
        if not len(keys):
            return old.keys, old.values
        order = np.argsort(keys, kind="stable")
        keys, points = keys[order], points[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        has = ~np.isnan(points[:, 1]) if width else np.zeros(len(keys), bool)
        n, size = np.add.reduceat(has.astype(float), first), np.diff(np.append(first, len(keys)))
        with np.errstate(invalid="ignore"):
            means = np.add.reduceat(np.where(has[:, None], points[:, 1:], 0.0), first) / n[:, None]
        fresh = np.hstack([np.minimum.reduceat(points[:, :1], first), np.maximum.reduceat(points[:, :1], first), size[:, None].astype(float), n[:, None], means])
        both, a, b = _fused(old, keys[first], fresh)
        low, high = np.fmin(a[:, 0], b[:, 0]), np.fmax(a[:, 1], b[:, 1])
        if self.cleanup:
            gone = (a[:, 1] - low > self.overhang) & (b[:, 1] - b[:, 0] < self.overhang)
            high = np.where(gone, b[:, 1], high)
        counts = np.nan_to_num(a[:, 2:4]) + np.nan_to_num(b[:, 2:4])
        return both, np.hstack([low[:, None], high[:, None], counts, _averaged(a[:, 4:], b[:, 4:], self.alpha)])


class _Tiles(StatefulProcessor):
    """A tile's cells as its value state; with `forget`, a timer drops a tile that no tick has reached for so many seconds of event time."""

    def __init__(self, map_: TickMap, forget: float | None) -> None:
        self.map, self.forget = map_, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tile", "tick long, low_x long, low_y long, keys binary, values binary")

    def _load(self) -> Tile:
        if not self.state.exists():
            return Tile.empty(len(self.map.layers))
        tick, low_x, low_y, keys, values = self.state.get()
        return Tile(np.frombuffer(keys, np.int64), np.frombuffer(values).reshape(-1, len(self.map.layers)), tick, (low_x, low_y))

    def _keep(self, tile: Tile) -> None:
        self.state.update((tile.tick, *tile.low, tile.keys.tobytes(), np.ascontiguousarray(tile.values).tobytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tile, touched = self._load(), False
        messages = pd.concat(list(rows)).sort_values("tick")  # the ticks of one micro-batch
        for m in messages.itertuples(index=False):
            tile, changed = self.map.apply(tile, m)
            touched |= changed
        self._keep(tile)
        if self.forget is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((messages["stamp"].max() + self.forget) * 1000))
        if touched:
            yield self.map.frame(*key, tile)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tile = self._load()
        gone = Tile(tile.keys[:0], tile.values[:0], tile.tick, tile.low)
        self._keep(gone)
        if len(tile.keys):
            yield self.map.frame(*key, gone)

    def close(self) -> None:
        pass


class TickStream:
    """A map kept up to date by a stream of scans, and its tiles as a table of which a batch rewrites those that change, and the one where the box begins."""

    def __init__(self, spark: SparkSession, folder: str, map_: TickMap, forget: float | None = None) -> None:
        self.spark, self.folder, self.map, self.forget = spark, folder, map_, forget

    def changes(self, scans: DataFrame) -> DataFrame:
        """Cells of the tiles that a micro-batch changes; a row without a cell: the tile is empty now."""
        messages = self.map.messages(scans)
        if self.forget is not None:
            messages = messages.withColumn("_at", F.timestamp_seconds("stamp")).withWatermark("_at", "0 seconds")
        mode = "None" if self.forget is None else "EventTime"
        return messages.groupBy(*TILE).transformWithStateInPandas(_Tiles(self.map, self.forget), StructType.fromDDL(self.map.schema()), "Update", mode)

    def write(self, batch: DataFrame, number: int) -> None:
        """foreachBatch: the changed tiles take the place of their former rows; written again after a failure they are the same."""
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TILE).parquet(self.folder)

    def start(self, scans: DataFrame, checkpoint: str, **trigger):
        return self.changes(scans).writeStream.outputMode("update").foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()

    def cells(self) -> DataFrame:
        """Cells in the box at the last tick of each run, which the tile where the box begins tells; tiles that a jump left behind are outside."""
        known = self.spark.read.schema(self.map.schema()).parquet(self.folder)
        last = known.groupBy("run").agg(F.max_by(F.struct("low_x", "low_y"), "tick").alias("_low"))
        inside = F.lit(True)
        for a, n in zip("xy", self.map.base.n, strict=False):
            inside = inside & (F.col(f"g{a}") >= F.col(f"_low.low_{a}")) & (F.col(f"g{a}") < F.col(f"_low.low_{a}") + n)
        return known.where("gx is not null").join(last, "run").where(inside).drop("_low", "low_x", "low_y")


#: Needed by the state of transformWithStateInPandas.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def scans_of(points: DataFrame, poses: DataFrame, features: list[str]) -> DataFrame:
    """Scans as messages of a sensor hold them, from tables: one row a tick with its points in an array, which the sensor bounds."""
    order = {"prev": lambda w: F.lag("tick").over(w)}
    heads = temporal.looking_back(poses.withColumn("t", F.col("tick")), "run", 1, order, slice_us=4096).drop("t")
    held = points.groupBy("run", "tick").agg(F.collect_list(F.struct(*AXES, *features)).alias("points"))
    empty = F.array().cast(held.schema["points"].dataType)
    return heads.join(held, ["run", "tick"], "left").withColumn("points", F.coalesce("points", empty))
