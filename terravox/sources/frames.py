"""Frames of recorded runs as Parquet: a folder for each run, topic and frame, and a small table of what each frame is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("run", "topic", "frame")


def save(rows: DataFrame, about: DataFrame, path: str) -> None:
    """rows: (run, topic, frame, ...) of the frames' content; about: one row (run, topic, frame, ...) of each frame.

    A frame's rows come together first, so that its folder holds one file; folders of other frames stay.
    """
    for df, part in ((rows, "rows"), (about, "about")):
        by = ORDER if part == "rows" else ORDER[:2]
        df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{part}")


def _chosen(df: DataFrame, run: str | None, topic: str | None, first: int | None, last: int | None) -> DataFrame:
    asked = [(F.col("run") == run, run), (F.col("topic") == topic, topic), (F.col("frame") >= first, first), (F.col("frame") <= last, last)]
    for condition, value in asked:
        df = df if value is None else df.where(condition)
    return df


def load(spark: SparkSession, path: str, run: str | None = None, topic: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Content of the frames first .. last: folders of others are not read."""
    return _chosen(spark.read.parquet(f"{path}/rows"), run, topic, first, last)


def about(spark: SparkSession, path: str, run: str | None = None, topic: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """What the frames are, without a look at their content."""
    return _chosen(spark.read.parquet(f"{path}/about"), run, topic, first, last)


def repeated(rows: DataFrame, n: int, name: str = "item") -> DataFrame:
    """Each row n times, numbered 0 .. n - 1."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else rows.withColumn(name, F.lit(0)).where("false")
