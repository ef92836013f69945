"""Structured Streaming: a voxel map that is kept up to date, latest messages, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import KEYS, GridMeta
from ..operators import covariance, voxel


class VoxelMap:
    """State of a mapper as versions of a Parquet table, one for each batch.

    A batch reads the newest version before its own number and writes version `number`: replayed after a failure it
    writes the same rows again, so the state holds every scan once. Stored keys count from the frame's zero, so that the
    box may move by whole cells (assign another meta): what leaves it is dropped, what stays keeps its voxel.
    """

    def __init__(self, spark: SparkSession, folder: str, meta: GridMeta, features: list[str], alpha: float, stamp: str = "stamp", cull_share: float | None = 0.75) -> None:
        self.spark, self.folder, self.meta, self.features, self.alpha, self.stamp, self.cull_share = spark, folder, meta, features, alpha, stamp, cull_share

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and done(s.getPath()))

    def state(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self._versions() if before is None or v < before]
        return self._keys(self.spark.read.parquet(f"{self.folder}/v={known[-1]}"), -1) if known else None

    def _keys(self, voxels: DataFrame, sign: int) -> DataFrame:
        """Keys of the box moved to those of the frame (sign 1), or back."""
        return voxels.withColumns({k: F.col(k) + F.lit(sign * round(o / r)) for k, o, r in zip(KEYS, self.meta.origin, self.meta.resolution, strict=True)})

    def update(self, batch: DataFrame, number: int) -> None:
        """foreachBatch: merge a batch of points, cull, and write the next version."""
        new = self._scan(batch)
        old = self.state(number)
        kept = new if old is None else self._merged(old.where(self.meta.contains_keys()), new)
        self._keys(self._culled(kept), 1).write.mode("overwrite").parquet(f"{self.folder}/v={number}")

    def _scan(self, batch: DataFrame) -> DataFrame:
        return voxel.voxelize(batch, self.meta, self.features, F.col(self.stamp), "avg")

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return voxel.merge(old, new, self.features, self.alpha)

    def _culled(self, voxels: DataFrame) -> DataFrame:
        return voxels if self.cull_share is None else voxel.cull(voxels, self.cull_share)

    def clear(self, number: int) -> None:
        """Forget the map: version `number` has no voxels. Nothing is written where there was none before."""
        old = self.state(number)
        if old is not None:
            self._keys(old.where("false"), 1).write.mode("overwrite").parquet(f"{self.folder}/v={number}")

    def start(self, points: DataFrame, checkpoint: str, **trigger):
        return points.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()


class CovarianceMap(VoxelMap):
    """A map of Gaussians: points bring their covariance in six columns cov_*; nothing is culled."""

    def _scan(self, batch: DataFrame) -> DataFrame:
        known = voxel.keyed(batch, self.meta).where(covariance.positive(covariance.of("cov")))
        return covariance.fuse_points(covariance.without_outliers(known, "cov"), list(KEYS), "cov", self.features)

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return covariance.merge(old, new, list(KEYS), self.features)

    def _culled(self, voxels: DataFrame) -> DataFrame:
        return voxels


#: Mappers by the names that configurations use.
MAPPERS = {"voxel": VoxelMap, "voxel_covariance": CovarianceMap}


def transforms(odometry: DataFrame, parent: str = "odom", child: str = "base_link") -> DataFrame:
    """Odometry (t, px .. pz, qx .. qw) as messages of a transform between two frames; a stream or a table."""
    vector = lambda names, prefix: F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in names))
    return odometry.select(F.col("t").alias("stamp"), F.lit(parent).alias("frame_id"), F.lit(child).alias("child_frame_id"), vector("xyz", "p").alias("translation"), vector("xyzw", "q").alias("rotation"))


def latest_messages(stream: DataFrame, key: str, stamp: str, fields: list[str]) -> DataFrame:
    """The newest message of each key so far (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(stamp, *fields), stamp).alias("m")).select(key, "m.*")


def without_repeats(stream: DataFrame, keys: list[str], stamp: str, within: str) -> DataFrame:
    """Messages whose keys have not come within the delay."""
    return stream.withWatermark(stamp, within).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, stamp: str, key: str, value: str, length: str, slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Count and mean per key and window; rows later than the watermark are left out."""
    window = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    return stream.withWatermark(stamp, late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def ready(clouds: DataFrame, odometry: DataFrame, key: str, within: str, late: str = "1 minute") -> DataFrame:
    """Clouds that have odometry of the same key within the interval: a join of two streams. Both have a column ts."""
    a, b = clouds.withWatermark("ts", late).alias("a"), odometry.withWatermark("ts", late).alias("b")
    on = f"a.{key} = b.{key} and b.ts between a.ts - interval {within} and a.ts + interval {within}"
    return a.join(b, F.expr(on)).select("a.*", F.col("b.ts").alias("odom_ts"))
