"""Labels and masks of images: one-hot layers, coarse classes, run lengths, bits, and tallies of runs."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(label: Column, n: int) -> Column:
    """Array of n entries, 1.0 at the label; all 0.0 for a label outside, null for null."""
    return F.when(label.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == label).cast("double")))


def coarse(label: Column, classes: Mapping[int, int], void: int = 255) -> Column:
    """Coarse class of a fine one: -1 for the void label, 0 for one that the mapping lacks. The mapping is a bounded list."""
    known = F.create_map(*(F.lit(int(v)) for pair in sorted(classes.items()) for v in pair)) if classes else None
    found = F.lit(0) if known is None else F.coalesce(F.try_element_at(known, label.cast("int")), F.lit(0))
    return F.when(label == void, -1).when(label.isNotNull(), found)


def min_max_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value scaled to [0, 1] within each key whose largest is above 0; other keys stay, constant ones become 0."""
    ends = rows.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    met = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")))
    scaled = F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.when(F.col(value).isNotNull(), 0.0))
    return met.withColumn(value, F.when(F.col("_hi") > 0, scaled).otherwise(F.col(value))).select(*rows.columns)


def bit(value: Column, k: Column) -> Column:
    """The k-th bit of an integer, from the lowest."""
    return F.getbit(value, k)


def run_lengths(text: Column) -> Column:
    """Lengths of the runs of zeros and ones by turns that a compressed mask string stores.

    A length is a number of five bits a character (from code 48 on, the sixth bit says that more follow, the sign is carried
    up); from the fourth length on it is the difference to the one two before. Null, empty or cut strings give what is whole.
    """

    @F.pandas_udf("array<long>")
    def read(column: pd.Series) -> pd.Series:
        def one(coded: str | None) -> list[int] | None:
            if coded is None:
                return None
            lengths, value, shift = [], 0, 0
            for c in coded:
                digit = ord(c) - 48
                value |= (digit & 31) << shift
                shift += 5
                if digit & 32:
                    continue
                if digit & 16:
                    value -= 1 << shift
                lengths.append(value + (lengths[-2] if len(lengths) > 2 else 0))
                value = shift = 0
            return lengths

        return column.map(one)

    return read(text)


def mask_pixels(rows: DataFrame, keys: list[str], lengths: str, height: int) -> DataFrame:
    """Rows (keys, u, v) of the pixels under run-length masks, which go down the columns of images of this height."""
    runs = rows.select(*keys, F.posexplode(lengths).alias("_k", "_n"), F.col(lengths).alias("_all")).where("_k % 2 = 1 and _n > 0")
    start = F.aggregate(F.slice("_all", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    at = runs.withColumn("_s", start).select(*keys, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("_p"))
    return at.select(*keys, F.floor(F.col("_p") / height).cast("long").alias("u"), (F.col("_p") % height).cast("long").alias("v"))


def tally(status: DataFrame, run: str, ok: Column) -> DataFrame:
    """One row a run: steps, failed ones (a null counts as failed), and whether all went well."""
    failed = F.count(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(1))
    return status.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), failed.alias("failed"), (failed == 0).alias("succeeded"))
