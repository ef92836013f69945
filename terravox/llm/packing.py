"""Operator 10: packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: whole sequences of the limit first, then the
binary digits of the rest, largest first. Each piece is a sequence of its own, and pieces of one length form a bucket,
so that a batch of equal-length sequences needs no padding and none crosses documents.

Null and empty texts still hold the closing id and give one piece of length 1. Sequence ids are gapless from 0, shorter
lengths first; within a length they follow a hash of the document, so equal rows get different ids in any order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import documents, literal_array, materialize

LIMIT = 1024
#: Groups in which pieces of one length are numbered; their sizes (a bounded table) give each group's first number.
NUMBERING_GROUPS = 1024


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The vocabulary of a tokenizers file (byte-level BPE whose ids are its merge ranks), run by tiktoken: the ids are the same, several times faster.

    Texts are cut at the file's added tokens, as tokenizers cuts them; those that take blanks or word bounds into account are refused.
    """
    import tiktoken

    back = {c: b for b, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {path} that do not stand for their exact text")
    ranks = {bytes(map(back.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("terravox", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Powers of two that add up to n, none above limit (itself a power of two), longest first."""
    whole, rest = divmod(n, limit)
    return [limit] * whole + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, length, ids, ids_crc32, doc_tokens) of the decomposition; ids are empty unless with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(tokenizer(path, pattern).encode, allowed_special="all")
        for batch in batches:
            rows, times = [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                start = 0
                for n in lengths(len(ids), limit):
                    piece = ids[start : start + n]
                    rows.append((start, n, piece.astype(np.int32) if with_ids else [], zlib.crc32(piece.tobytes()), len(ids)))
                    start += n
                times.append(len(lengths(len(ids), limit)))
            doc_id = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(times)), times)))
            columns = zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64()), strict=True)
            yield pa.record_batch([doc_id, *(pa.array(v, kind) for v, kind in columns)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset (0, as a sequence is one piece); written once, so that no text is encoded twice."""
    cut = pieces(docs, path, pattern, limit, with_ids=with_ids)
    cut = materialize(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(NUMBERING_GROUPS))), "pieces")
    # The bounded table of group sizes: at most 11 lengths by NUMBERING_GROUPS.
    sizes = {(r["length"], r["part"]): r["count"] for r in cut.groupBy("length", "part").count().collect()}
    first, total = [], 0
    for n in (1 << k for k in range(limit.bit_length())):
        for part in range(NUMBERING_GROUPS):
            first.append(total)
            total += sizes.get((n, part), 0)
    group = F.log2("length").cast("int") * NUMBERING_GROUPS + F.col("part")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    return cut.withColumn("within", within).select(
        "doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens",
        (literal_array(first, "bigint")[group.cast("int")] + F.col("within") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
