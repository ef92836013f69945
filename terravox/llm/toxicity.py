"""Operator 2: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends), hashed into a fixed number of embeddings; the mean of
these goes through two linear outputs and a softmax. Misspellings and inflections share n-grams with the words they come
from. A text is as toxic as its worst passage of PASSAGE_WORDS words: the log odds of that passage, set right by a slope
and an intercept that are fitted on the sample, give the score.

The model is fitted on the driver on a bounded sample: at most SAMPLE_ROWS labelled rows a class, in order of a hash of
the id, of texts up to SAMPLE_BYTES; rows of the held-out fold never enter. Every whole text is scored on executors.

Null, empty and wordless texts get the score of an empty passage (the outputs' bias alone). Labels with null id or class
are skipped; of several labels for an id the highest counts. Without labels of both classes every score is 0. Repeated
rows get repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, words_of

BUCKETS = 1 << 16
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
PASSAGE_WORDS = 1
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 1 << 14
EPOCHS = 20
DECAY = 1.0
HELD_OUT = 1
FOLDS = 3
DECISION = 0.7
#: A worker forgets its known words beyond this many.
KNOWN_WORDS = 400_000
#: Words whose n-grams are worked out, or their vectors gathered, at a time.
SLICE = 1 << 14
#: Odd multiplier of the n-gram hash (fixed value).
MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, word after word, and where each word's begin."""
    parts = [_subwords(words[k : k + SLICE], buckets) for k in range(0, max(1, len(words)), SLICE)]
    before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([at + n for (_, at), n in zip(parts, before, strict=False)])


def _subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(b"<" + w + b">" for w in words)
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    for n in NGRAMS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * MIX
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h[inside] % np.uint64(buckets)).astype(np.int32))
        of.append(owner[: len(h)][inside])
    ids, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(words)))


@dataclass
class Model:
    """Embeddings and softmax outputs; margin is each bucket's share of the difference of the two outputs."""

    embeddings: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    @property
    def margin(self) -> np.ndarray:
        return (self.slope * (self.embeddings @ (self.outputs[:, 1] - self.outputs[:, 0]))).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.slope * (self.bias[1] - self.bias[0]) + self.intercept)


def lower_words(text: str | None) -> list[bytes]:
    return [w.lower() for w in words_of(text)]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic regression, by Newton steps with a little shrinkage."""
    x, beta = np.stack([z, np.ones_like(z)], 1).astype(np.float64), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (q - y) + 0.1 * (beta - [1, 0])), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, decay: float = DECAY, seed: int = 7, lr: float = 0.25) -> Model:
    """Joint training of embeddings and outputs by Adam, a word of a text being an example of the text's class.

    A word counts once a text. The ridge on embeddings keeps what few texts say small, so that chance words of toxic
    texts stay near even odds; the worst word of each text then gives the text's log odds through a slope and intercept.
    """
    rng, y = np.random.default_rng(seed), np.asarray(labels)
    vocabulary: dict[bytes, int] = {}
    codes, owner = [], []
    for d, text in enumerate(texts):
        own = {vocabulary.setdefault(w, len(vocabulary)) for w in lower_words(text)}
        codes += own
        owner += [d] * len(own)
    codes, owner = np.array(codes), np.array(owner)
    bad = np.bincount(codes, y[owner] == 1, minlength=len(vocabulary)).astype(np.float32)
    good = np.bincount(codes, y[owner] == 0, minlength=len(vocabulary)).astype(np.float32)
    good *= bad.sum() / max(1.0, good.sum())
    ids, at = subwords(list(vocabulary))
    size = np.diff(np.append(at, len(ids))).astype(np.float32)[:, None]
    spread = np.repeat(np.arange(len(at), dtype=np.int32), size[:, 0].astype(int))
    del codes, owner
    p = {"e": rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)), "w": rng.normal(0, 1, (DIMENSIONS, 2)), "b": np.zeros(2)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    word, edges = np.empty((len(at), DIMENSIONS), np.float32), [*range(0, len(at), SLICE), len(at)]
    for epoch in range(1, epochs + 1):
        for lo, hi in zip(edges, edges[1:], strict=False):  # a slice of the words at a time
            first, last = at[lo], at[hi] if hi < len(at) else len(ids)
            word[lo:hi] = np.add.reduceat(p["e"][ids[first:last]], at[lo:hi] - first) / size[lo:hi]
        z = word @ p["w"] + p["b"]
        q = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
        g = (q * (bad + good) - bad)[:, None] * np.array([[-1, 1]], np.float32)
        back = (g @ p["w"].T) / size
        grad = {"w": word.T @ g, "b": g.sum(0)}
        grad["e"] = np.stack([np.bincount(ids, back[spread, k], minlength=BUCKETS) for k in range(DIMENSIONS)], 1).astype(np.float32) + decay * p["e"]
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= lr * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    model = Model(p["e"], p["w"], p["b"])
    scorer = Scorer(model.margin, model.offset)
    slope, intercept = calibrate(np.concatenate([scorer.margins(texts[k : k + 200]) for k in range(0, len(texts), 200)]), y)
    return Model(p["e"], p["w"], p["b"], slope, intercept)


class Scorer:
    """Scores texts; a word's share of the margin is worked out once."""

    def __init__(self, margin: np.ndarray, offset: float) -> None:
        self.margin, self.offset, self.place, self.share = margin, offset, {}, np.zeros(0, np.float32)

    def __call__(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(texts).astype(np.float64)))

    def margins(self, texts) -> np.ndarray:
        """Log odds of each text's worst passage."""
        if len(self.place) > KNOWN_WORDS:
            self.place, self.share = {}, np.zeros(0, np.float32)
        place, codes, starts, first = self.place, [], [], []
        for text in texts:
            words = words_of(text)
            first.append(len(starts))
            starts.extend(range(len(codes), len(codes) + max(1, len(words)), PASSAGE_WORDS))
            codes += [place.setdefault(w, len(place)) for w in words] or [-1]
        new = list(place)[len(self.share) :]
        if new:
            ids, at = subwords([w.lower() for w in new])
            sizes = np.diff(np.append(at, len(ids)))
            self.share = np.append(self.share, np.add.reduceat(self.margin[ids], at) / sizes)
        if not first:
            return np.zeros(0)
        known = np.append(self.share, np.float32(0))  # -1: no word
        sizes = np.diff(np.append(starts, len(codes)))
        z = np.add.reduceat(known[np.array(codes)], starts) / sizes + self.offset
        return np.maximum.reduceat(z, first)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on the bounded sample; None without both classes."""
    classes = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Ids of four times the rows, as some texts are too long or missing: a bounded broadcast.
    chosen = [classes.where(F.col("toxic") == c).orderBy(*order).limit(4 * rows) for c in (0, 1)]
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = [found.where(F.col("toxic") == c).orderBy(*order, "text").limit(rows).select("text", "toxic").collect() for c in (0, 1)]
    kept = [r for part in sample for r in part if words_of(r["text"])]
    y = np.array([r["toxic"] for r in kept])
    return fit([r["text"] for r in kept], y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with score (probability of toxic)."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    margin, offset = model.margin, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(margin, offset)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.concatenate([scorer(texts[k : k + 500]) for k in range(0, max(1, len(texts)), 500)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= DECISION, 1).otherwise(0).alias("predicted"))
