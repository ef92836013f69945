"""Fitted models as small Parquet tables: projections, vocabularies and prototypes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_pca(spark: SparkSession, path: str, mean: list[float], basis, share) -> None:
    """The mean is component -1."""
    rows = [(-1, [float(x) for x in mean], 0.0)] + [(k, [float(x) for x in v], float(s)) for k, (v, s) in enumerate(zip(np.asarray(basis).T, share, strict=True))]
    spark.createDataFrame(rows, "component int, v array<double>, share double").coalesce(1).write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str, q: int | None = None):
    """(mean, basis of the first q columns, share of energy), as vectors.fit_pca gives them."""
    kept = spark.read.parquet(path).where(F.lit(True) if q is None else F.col("component") < q).orderBy("component").collect()
    return kept[0]["v"], np.array([r["v"] for r in kept[1:]]).T, np.array([r["share"] for r in kept[1:]])


def save_centres(centres: DataFrame, path: str) -> None:
    """A vocabulary or prototypes: rows (label, c), more columns as they are."""
    centres.write.mode("overwrite").parquet(path)


def load_centres(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """The table that save_centres wrote; an error if its vectors are not of the size that the caller works with."""
    centres = spark.read.parquet(path)
    if size is not None and centres.where(F.size("c") != size).limit(1).count():
        raise ValueError(f"{path} holds vectors that have not {size} entries")
    return centres
