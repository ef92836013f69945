"""Files of a run: arrays, stamps and packed points; and the sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta


def npy_frames(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, frame_id, shape, values) of .npy files, found at any depth; frame_id is the number in the name."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "shape": [list(a.shape) for a in arrays], "values": [a.astype(np.float64).ravel() for a in arrays]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    rows = files.select("path", "content").mapInPandas(load, "path string, shape array<int>, values array<double>")
    return rows.select("path", F.regexp_extract("path", r"(\d+)\.npy$", 1).try_cast("int").alias("frame_id"), "shape", "values")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, values) of text files with numbers between blanks, such as stamps and poses; null for what is no number."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("line")).where("line <> ''")
    return lines.select("path", F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def image_pixels(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Rows (path, v, u, r, g, b) in [0, 1] of image files; one channel counts for all three, a fourth is left out.

    A file that is no image gives one row of nulls beside its path, or none with drop_invalid.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, w, h, n, raw in zip(batch["origin"], batch["width"], batch["height"], batch["nChannels"], batch["data"], strict=True):
                if w <= 0 or h <= 0:
                    yield pd.DataFrame({"path": [name], **{c: [None] for c in ("v", "u", "r", "g", "b")}})
                    continue
                bgr = np.frombuffer(raw, np.uint8).reshape(h, w, n)[..., : 1 if n == 1 else 3] / 255.0
                v, u = np.divmod(np.arange(h * w), w)
                flat = np.broadcast_to(bgr, (h, w, 3)).reshape(-1, 3)
                yield pd.DataFrame({"path": name, "v": v, "u": u, "r": flat[:, 2], "g": flat[:, 1], "b": flat[:, 0]})

    images = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    return images.select("origin", "width", "height", "nChannels", "data").mapInPandas(decode, "path string, v long, u long, r double, g double, b double")


def packed_points(df: DataFrame, content: str = "content", colour: bool = False) -> DataFrame:
    """Points of binary records: three little-endian floats, with 0xRRGGBB in a fourth field if colour."""
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("rgb", "<u4")] if colour else []))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, raw in zip(batch["frame_id"], batch[content], strict=True):
                p = np.frombuffer(raw, kind)
                out = pd.DataFrame({"frame_id": frame, "x": p["x"].astype(float), "y": p["y"].astype(float), "z": p["z"].astype(float)})
                yield out.assign(rgb=p["rgb"].astype(np.int64)) if colour else out

    return df.select("frame_id", content).mapInPandas(read, "frame_id long, x double, y double, z double" + (", rgb long" if colour else ""))


def pack_points(points: DataFrame, frame: str = "frame_id", order: str | None = None, colour: bool = False) -> DataFrame:
    """Rows (frame, content, n): the records that packed_points reads, one a frame, in the order of a column; a frame's points are bounded by its sensor."""
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("rgb", "<u4")] if colour else []))
    names = [*kind.names]

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order) if order else group
        out = np.zeros(len(group), kind)
        for c in names:
            out[c] = group[c].to_numpy()
        return pd.DataFrame({frame: group[frame].iloc[:1], "content": [out.tobytes()], "n": [len(group)]})

    kept = points.select(frame, *names, *([order] if order and order not in names else []))
    return kept.groupBy(frame).applyInPandas(write, f"{frame} {points.schema[frame].dataType.simpleString()}, content binary, n long")


def valid_points(points: DataFrame, least: float = 1e-5) -> DataFrame:
    """Without points at the origin or with NaN."""
    norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return points.where((norm > least) & ~F.isnan(norm))


def ontology(spark: SparkSession, classes: dict) -> DataFrame:
    """Rows (id, label, prompt, color) of a dictionary by id; a small table."""
    rows = [(int(k), v["label"], v.get("prompt", v["label"]), [int(c) for c in v["color"]]) for k, v in sorted(classes.items(), key=lambda x: int(x[0]))]
    return spark.createDataFrame(rows, "id int, label string, prompt string, color array<int>")


def write_frames(df: DataFrame, path: str, frame: str = "frame_id") -> None:
    """Parquet with a folder for each frame; each frame's rows come together first, so that it is one file a task."""
    df.repartition(frame).write.mode("overwrite").partitionBy(frame).parquet(path)


def voxel_message(voxels: DataFrame, features: list[str], meta: GridMeta | None = None) -> DataFrame:
    """Sparse message rows: key, features as one array, evidence where the voxels have it, and the grid's numbers beside each."""
    about = [] if meta is None else [F.array(*(F.lit(float(v)) for v in values)).alias(name) for name, values in (("origin", meta.origin), ("length", meta.length), ("resolution", meta.resolution))]
    evidence = [c for c in ("hits", "misses") if c in voxels.columns]
    return voxels.select("gx", "gy", "gz", F.array(*features).alias("features"), F.lit(",".join(features)).alias("feature_keys"), *evidence, *about)
