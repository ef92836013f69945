"""Operator 8: substring dedup by level-wise doubling.

Windows of a short length are looked for first. A start survives a level if its window's word sequence starts anywhere
else too; it can survive the next, about twice as long, only if both shorter windows that make up the longer one
survived. So each level asks only about starts that are left, and levels end at the wanted length or when none is left.
Every word under a surviving window of the last level goes.

Documents are dealt into blocks by a hash. For each level a block sends each of its distinct window hashes once, sorted
into buckets by hash; a bucket answers with one bit a hash: sent by another block as well. Within a block repeats are
seen at once, so a passage that a third of all documents hold costs one hash a block. Hashes travel sorted, as differences. The first level sends 32 bits
within its bucket (buckets have a constant number of windows, so chance agreement, which only lets a start through to
the next level, stays constant too); later levels send all 64 bits.

Null, empty and wordless texts have no words: nothing removed, digest of the empty text. Texts shorter than the window
stay whole. Repeated rows are copies like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, by_range, distinct, documents, materialize, mixed, pack, unpack, word_hashes

WINDOW = 35
SHORTEST = 9
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 256
#: Window hashes that a bucket is made for; a text has about a word for every 5 bytes.
BUCKET_WINDOWS = 2_000_000


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Lengths from at most `shortest` to window, each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` word hashes, by doubling: the hash of a run from those of its halves."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    total, size, power, width, factor = None, 0, h, 1, int(MIX)
    for bit in bin(length)[:1:-1]:
        if bit == "1":
            n = len(h) - (size + width) + 1
            total = power[:n].copy() if total is None else total[:n] * np.uint64(factor) + power[size : size + n]
            size += width
        if 2 * width <= length:
            power = power[: len(power) - width] * np.uint64(factor) + power[width:]
        width, factor = 2 * width, factor * factor % 2**64
    return mixed(total + np.uint64(length))


class Block:
    """The documents of a block, in a fixed order, their word hashes end to end."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts = [t or b"" for t in self.table.column("text").cast(pa.binary()).to_pylist()]
        self.hashes, self.sizes = word_hashes(self.texts)
        self.ends = np.repeat(np.cumsum(self.sizes), self.sizes)

    def starts(self, length: int, before: int | None, survived: np.ndarray | None) -> np.ndarray:
        """Starts whose window fits its document and whose shorter windows survived."""
        p = np.arange(len(self.hashes)) if survived is None else np.flatnonzero(survived)
        p = p[p + length <= self.ends[p]]
        return p if survived is None else p[survived[p + length - before]]


def _answered(block: Block, lengths: list[int], answers: dict[tuple[int, int], bytes], buckets: int):
    """Replay the levels that have answers: (next level, its distinct hashes, rising) or, after the last level, the survivors."""
    survived, before, replied = None, None, {level for level, _ in answers}
    for level, length in enumerate(lengths):
        p = block.starts(length, before, survived)
        h = window_hashes(block.hashes, length)[p] if len(p) else np.zeros(0, np.uint64)
        if len(h) and level not in replied:
            return level, distinct(h), None
        key, back, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count > 1
        for b, at in by_range(key, buckets):
            again[at] |= np.unpackbits(np.frombuffer(answers[level, b], np.uint8), count=at.stop - at.start).astype(bool)
        survived, before = np.zeros(len(block.hashes), bool), length
        survived[p] = again[back]
    return len(lengths), None, survived


def _packed(level: int, key: np.ndarray, buckets: int) -> bytes:
    """Rising hashes of a bucket as differences: at the first level by 32 bits of what sets them apart there, later by all."""
    apart = key % np.uint64(2**64 // buckets + 1)
    return pack(np.diff(apart >> np.uint64(max(0, 33 - buckets.bit_length()) if level == 0 else 0), prepend=np.uint64(0)))


ASK = "block int, level int, bucket int, keys binary"
REPLY = "block int, level int, bucket int, bits binary"


def _ask(lengths: list[int], buckets: int):
    def ask(docs: pa.Table, replies: pa.Table | None) -> pa.Table:
        rows: dict[str, list] = {"block": [], "level": [], "bucket": [], "keys": []}
        if docs.num_rows:
            answers = {} if replies is None else {(r["level"], r["bucket"]): r["bits"] for r in replies.to_pylist()}
            level, key, _ = _answered(Block(docs), lengths, answers, buckets)
            for b, at in by_range(key, buckets) if level < len(lengths) else []:
                for name, value in zip(rows, (docs.column("block")[0].as_py(), level, b, _packed(level, key[at], buckets)), strict=True):
                    rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("block", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())]))

    def first(docs: pa.Table) -> pa.Table:
        return ask(docs, None)

    def later(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return ask(docs, replies)

    return first, later


def _reply(asked: pa.Table) -> pa.Table:
    """For each block that asked this bucket: which of its hashes another block has sent."""
    parts = [np.cumsum(unpack(k), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    again, bits, at = count[back] > 1, [], 0
    for part in parts:
        bits.append(np.packbits(again[at : at + len(part)]).tobytes())
        at += len(part)
    return pa.table({"block": asked.column("block"), "level": asked.column("level"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _finish(lengths: list[int], buckets: int, with_text: bool, names: list[str]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs)
        answers = {(r["level"], r["bucket"]): r["bits"] for r in replies.to_pylist()}
        *_, survived = _answered(block, lengths, answers, buckets)
        gone = np.zeros(len(block.hashes) + 1, np.int64)
        if survived is not None:  # otherwise no start was left before the last level
            p = np.flatnonzero(survived)
            np.add.at(gone, p, 1)
            np.add.at(gone, p + lengths[-1], -1)
        keep = np.cumsum(gone)[:-1] == 0
        removed = np.array([np.count_nonzero(~keep[b - n : b]) for b, n in zip(np.cumsum(block.sizes).tolist(), block.sizes.tolist(), strict=True)], np.int64)
        kept, at = [], 0
        for text, n, r in zip(block.texts, block.sizes.tolist(), removed.tolist(), strict=True):
            words = text.split()  # bytes.split() cuts at the same six separators
            kept.append(b" ".join(itertools.compress(words, keep[at : at + n].tolist()) if r else words))
            at += n
        text = [k.decode() for k in kept] if with_text else [""] * len(kept)
        out = block.table.select(names)
        for name, values in (("n_words", pa.array(block.sizes)), ("n_removed", pa.array(removed)), ("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())), ("kept", pa.array(text, pa.string()))):
            out = out.append_column(name, values)
        return out

    return run


def dedup(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, with_text: bool = True, carry: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept), one per row of docs; kept is empty unless with_text.

    With carry, all columns of docs come along instead of doc_id alone (but for any named like a result or the block).

    Texts are dealt to their blocks once, as a table in the shared folder: no level depends on how the input was planned.
    """
    own = ("n_words", "n_removed", "kept_sha256", "kept", "block")
    docs = docs.drop(*own).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    docs = docs if carry else docs.select("doc_id", "text")
    names = docs.columns if carry else ["doc_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", n_words long, n_removed long, kept_sha256 string, kept string"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    buckets = max(64, -(-size // (5 * BUCKET_WINDOWS)))
    lengths = levels(window, shortest)
    # Neither one id nor rows that are wholly equal are one block's alone. Blocks are written, so that all levels see the same.
    dealt = materialize(docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")), "dealt")
    grouped = dealt.groupBy("block")
    replies, (first, later) = None, _ask(lengths, buckets)
    for _ in lengths:
        asked = grouped.applyInArrow(first, ASK) if replies is None else grouped.cogroup(replies.groupBy("block")).applyInArrow(later, ASK)
        reply = asked.groupBy("bucket").applyInArrow(_reply, REPLY).repartition("block")
        replies = reply if replies is None else replies.union(reply)
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(_finish(lengths, buckets, with_text, names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_text=False).drop("kept")
