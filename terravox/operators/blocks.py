"""Images through a chain of blocks: checked when the chain is built, run in one Arrow pass.

A block says which keys it gives for those it gets, and opens what it needs once a worker. Consecutive linear blocks become
one matrix. Images are rows with height, width and values (row by row, channels last); blocks may change the size, and the
camera's numbers (fx, cx, fy, cy) follow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Run = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Block:
    """run(features, original): arrays of (height, width, channels)."""

    def keys(self, given: tuple[str, ...]) -> tuple[str, ...]:
        raise NotImplementedError

    def open(self) -> Run:
        """Called once a worker and chain."""
        raise NotImplementedError


@dataclass(frozen=True)
class Featurizer(Block):
    """A network by a loader that gives model(image) -> features; weights come from the user."""

    loader: Callable[[], Callable[[np.ndarray], np.ndarray]]
    labels: tuple[str, ...]
    channels: int = 3

    def keys(self, given):
        if len(given) != self.channels:
            raise ValueError(f"featurizer takes {self.channels} channels, gets {len(given)}")
        return self.labels

    def open(self) -> Run:
        model = self.loader()
        return lambda features, original: model(features)


@dataclass(frozen=True)
class PatchStatistics(Block):
    """Stands for a network where there are no weights: mean, least and greatest value of each channel over square patches."""

    patch: int

    def keys(self, given):
        return tuple(f"{k}_{s}" for k in given for s in ("mean", "min", "max"))

    def open(self) -> Run:
        def run(features, original):
            h, w, c = features.shape
            if h % self.patch or w % self.patch:
                raise ValueError(f"image of {h} x {w} has no whole patches of {self.patch}")
            x = features.reshape(h // self.patch, self.patch, w // self.patch, self.patch, c)
            return np.stack([x.mean((1, 3)), x.min((1, 3)), x.max((1, 3))], -1).reshape(h // self.patch, w // self.patch, 3 * c)

        return run


@dataclass(frozen=True)
class Linear(Block):
    """(features - mean) @ matrix - off: normalisation, projection on components."""

    mean: tuple[float, ...]
    matrix: tuple[tuple[float, ...], ...]
    labels: tuple[str, ...]
    off: tuple[float, ...] | None = None

    def keys(self, given):
        if len(given) != len(self.mean) or len(self.matrix) != len(self.mean) or any(len(r) != len(self.labels) for r in self.matrix):
            raise ValueError(f"block {self.labels[:1]} takes {len(self.mean)} features, gets {len(given)}")
        return self.labels

    def then(self, other: Linear) -> Linear:
        """Both in one: ((x - m) A - a - n) B - b is (x - m) A B - ((a + n) B + b)."""
        b = np.array(other.matrix, float)
        off = (np.array(other.mean, float) + (0.0 if self.off is None else np.array(self.off))) @ b + (0.0 if other.off is None else np.array(other.off))
        return Linear(self.mean, tuple(map(tuple, (np.array(self.matrix, float) @ b).tolist())), other.labels, tuple(off.tolist()))

    def open(self) -> Run:
        mean, matrix, off = np.array(self.mean), np.array(self.matrix), 0.0 if self.off is None else np.array(self.off)
        return lambda features, original: (features - mean) @ matrix - off


@dataclass(frozen=True)
class Residuals(Block):
    """L1 distance of each pixel's vector, at length 1, to each centre of a vocabulary; a vector of zeros stays as it is."""

    centres: tuple[tuple[float, ...], ...]
    label: str = "vlad"

    def keys(self, given):
        if any(len(c) != len(given) for c in self.centres):
            raise ValueError(f"centres of {len(self.centres[0])} entries, {len(given)} features")
        return tuple(f"{self.label}_{k}" for k in range(len(self.centres)))

    def open(self) -> Run:
        centres = np.array(self.centres)

        def run(features, original):
            size = np.linalg.norm(features, axis=-1, keepdims=True)
            x = features / np.where(size == 0, 1.0, size)
            return np.stack([np.abs(x - c).sum(-1) for c in centres], -1)

        return run


@dataclass(frozen=True)
class Prototypes(Block):
    """Cosine of each pixel's vector with each named prototype; 0 for a vector of zeros."""

    named: tuple[tuple[str, tuple[float, ...]], ...]

    def keys(self, given):
        if any(len(p) != len(given) for _, p in self.named):
            raise ValueError(f"prototypes do not have {len(given)} entries")
        return tuple(n for n, _ in self.named)

    def open(self) -> Run:
        p = np.array([v for _, v in self.named])
        p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)

        def run(features, original):
            size = np.linalg.norm(features, axis=-1, keepdims=True)
            return (features / np.where(size == 0, 1.0, size)) @ p.T

        return run


def fused(blocks: tuple[Block, ...]) -> tuple[Block, ...]:
    out: list[Block] = []
    for b in blocks:
        if out and isinstance(out[-1], Linear) and isinstance(b, Linear):
            out[-1] = out[-1].then(b)
        else:
            out.append(b)
    return tuple(out)


@dataclass(frozen=True)
class Pipeline:
    """Blocks in turn for images of the given keys (channels); a block that does not fit is an error when this is made."""

    blocks: tuple[Block, ...]
    given: tuple[str, ...] = ("r", "g", "b")

    def __post_init__(self) -> None:
        self.output_feature_keys  # noqa: B018

    @property
    def output_feature_keys(self) -> tuple[str, ...]:
        keys = self.given
        for b in self.blocks:
            keys = b.keys(keys)
        return keys

    def run(self, images: DataFrame, key: list[str]) -> DataFrame:
        """Rows (key, height, width, values, camera) of images (key, height, width, values, and camera: array fx, cx, fy, cy or null).

        A null image, or one whose values do not fill its size, gives null features.
        """
        blocks, channels = fused(self.blocks), len(self.given)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = [b.open() for b in blocks]
            for batch in batches:
                out = []
                for h, w, values, camera in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "values", "camera")), strict=True):
                    if values is None or not h or not w or len(values) != h * w * channels:
                        out.append((None, None, None, None))
                        continue
                    original = features = np.array(values, float).reshape(h, w, channels)
                    for r in runs:
                        features = r(features, original)
                    nh, nw = features.shape[:2]
                    out.append((nh, nw, features.ravel(), None if camera is None else [camera[0] * nw / w, camera[1] * nw / w, camera[2] * nh / h, camera[3] * nh / h]))
                kinds = pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())
                columns = zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)
                yield pa.record_batch([*(batch.column(k) for k in key), *(pa.array(v, kind) for v, kind in columns)], names=[*key, "height", "width", "values", "camera"])

        kept = images if "camera" in images.columns else images.selectExpr("*", "cast(null as array<double>) camera")
        kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in key)
        return kept.selectExpr(*key, "cast(height as int) height", "cast(width as int) width", "cast(values as array<double>) values", "cast(camera as array<double>) camera").mapInArrow(go, f"{kinds}, height int, width int, values array<double>, camera array<double>")


#: Blocks by the names that configurations use: each takes the entry's arguments and the models it names.
REGISTRY: dict[str, Callable[..., Block]] = {
    "stub": lambda models, patch: PatchStatistics(patch),
    "normalise": lambda models, mean, deviation, labels=("r", "g", "b"): Linear(tuple(mean), tuple(tuple(1 / d if i == k else 0.0 for k in range(len(deviation))) for i, d in enumerate(deviation)), tuple(labels)),
    "pca": lambda models, model, n_features=-1, label="pca": _projection(*models[model][:2], n_features, label),
    "vlad": lambda models, model: Residuals(tuple(map(tuple, models[model]))),
    "pca_vlad": lambda models, pca, vlad, label="pca": _Both(_projection(*models[pca][:2], -1, label), Residuals(tuple(map(tuple, models[vlad])))),
    "traversability_prototypes": lambda models, model: Prototypes(tuple((k, tuple(v)) for k, v in models[model].items())),
}


def _projection(mean, basis, n: int, label: str) -> Linear:
    basis = np.asarray(basis, float)[:, : None if n < 0 else n]
    return Linear(tuple(map(float, mean)), tuple(map(tuple, basis.tolist())), tuple(f"{label}_{k}" for k in range(basis.shape[1])))


@dataclass(frozen=True)
class _Both(Block):
    """Two blocks side by side on the same features."""

    one: Block
    two: Block

    def keys(self, given):
        return self.one.keys(given) + self.two.keys(given)

    def open(self) -> Run:
        a, b = self.one.open(), self.two.open()
        return lambda features, original: np.concatenate([a(features, original), b(features, original)], -1)


def setup(config: list[dict], models: dict, given: tuple[str, ...] = ("r", "g", "b")) -> Pipeline:
    """A pipeline from entries {"type": name, "args": {...}}; models by the names that entries give."""
    unknown = [c["type"] for c in config if c["type"] not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown blocks: {unknown}")
    return Pipeline(tuple(REGISTRY[c["type"]](models, **c.get("args", {})) for c in config), given)
