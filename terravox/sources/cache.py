"""Results that are kept by what they were made from, so that only what is new is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .working import written


def digest(*columns: str) -> F.Column:
    """SHA-256 of values as text; arrays by their entries, nulls told apart from empty text."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


class ResultCache:
    """A table (source, model, mode, result) in a folder: results by digest of a descriptor, digest of the model, and mode.

    A changed model or mode misses. Rows that miss are computed once for equal descriptors and appended; a lost run before the
    append computes them again. Two writers at a time may both append a row; what is read is one of each.
    """

    KEY = ("source", "model", "mode")

    def __init__(self, spark: SparkSession, folder: str, result: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, f"source string, result {result}, model string, mode string"

    def _known(self, model: str, mode: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], "source string, result " + self.schema.split("result ", 1)[1].split(", model", 1)[0])
        kept = self.spark.read.schema(self.schema).parquet(self.folder).where((F.col("model") == model) & (F.col("mode") == mode))
        return kept.groupBy("source").agg(F.any_value("result").alias("result"))

    def get(self, rows: DataFrame, columns: list[str], model: str, mode: str, compute: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """rows with a column `name`: the result of each, known or computed now from its columns.

        compute gets rows (source, columns) and gives rows (source, result). Null columns are a value like any other.
        """
        keyed = rows.withColumn("source", digest(*columns))
        known = self._known(model, mode)
        absent = written(keyed.join(known, "source", "left_anti").groupBy("source").agg(*(F.first(c).alias(c) for c in columns)), "absent")
        if not absent.isEmpty():
            made = compute(absent).select("source", "result").withColumns({"model": F.lit(model), "mode": F.lit(mode)})
            made.write.mode("append").partitionBy("model", "mode").parquet(self.folder)
        return keyed.join(self._known(model, mode).withColumnRenamed("result", name), "source", "left").drop("source")


def model_digest(centres: DataFrame) -> str:
    """Digest of a vocabulary: of its vectors in the order of their labels."""
    listed = centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("all"))
    return listed.select(digest("all")).first()[0]
