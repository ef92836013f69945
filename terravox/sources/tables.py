"""Views over the test tables that stand for sensor data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta

#: Grid of the points and place of the sensor.
META = GridMeta((0.0, 0.0, 0.0), (50.0, 40.0, 21.0), (1.0, 1.0, 0.5))
SENSOR = (25.0, 20.0, 5.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven scans: x, y, z and two features, which are null where a point has none."""
    return scan_points(table(spark, sf_dir, "lineitem").withColumn("scan_id", F.year("l_shipdate") - 1995), "scan_id")


def scan_points(lines: DataFrame, *keys: str) -> DataFrame:
    has = F.col("l_returnflag") != "N"
    return lines.select(
        *keys, (F.col("l_quantity") - 0.5).alias("x"), (F.col("l_partkey") % 40 + 0.5).alias("y"), (F.col("l_extendedprice") / 10000.0).alias("z"),
        F.when(has, F.col("l_discount")).alias("f0"), F.when(has, F.col("l_tax")).alias("f1"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 40 x 40 map: mean height and number of readings per cell."""
    raw = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("i"), (F.dayofyear("o_orderdate") % 40).cast("long").alias("j"), (F.col("o_totalprice") / 100000.0).alias("z"))
    return raw.groupBy("i", "j").agg(F.avg("z").alias("z"), F.max("z").alias("top"), F.count(F.lit(1)).alias("n"))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vehicle per user: stamp in microseconds and a position on a line."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), micros("ts").alias("t"), F.col("value").alias("p"), "event_type")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def round6(c: Column | str) -> Column:
    """Six digits; the small shift keeps exact ties away from both sides' rounding."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)
