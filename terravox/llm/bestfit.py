"""Operator 11: best-fit packing with a bounded number of open bins.

A document's ids and its closing id are one piece, or pieces of the limit where there are more (the last may be shorter).
Pieces get a number of their own as they are written, and are dealt to groups of about GROUP by a hash of it: even,
whatever the rows hold, and the same for all that reads the written table. A group's pieces are packed online: each goes into the fullest open bin
that it fits, which a bitset keyed by free space finds in one step; where none has room a bin is opened, and when all
OPEN are in use the fullest closes first. What a group still has open at its end is packed again, bins as pieces,
in fewer groups, until one group is left, so that the number of groups costs no space.

Null and empty texts hold the closing id alone and are one piece of length 1. Rows of equal or null ids are documents of
their own; empty tables give no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import documents, materialize

LIMIT = 2048
#: Pieces that one task packs at a time, and bins that it keeps open.
GROUP, OPEN = 8_192, 256
#: Words, and parts of words, whose ids a worker remembers; beyond that it starts anew, with the same result.
KNOWN = 500_000


class WordIds:
    """Ids of texts under a tokenizers file with word ends, word by word.

    The file's normaliser and pattern never look across space, tab, line feed, vertical tab, form feed or carriage return, so a
    text's ids are those of its words in turn. A word of printable ASCII and Latin-1 letters is lower-cased and cut by the pattern,
    and its parts are merged by tiktoken, in whose ranks the byte WORD_END, which UTF-8 never has, stands for a word's end: the merges
    and their order are the same. Any other word, and one that may hold an added token, goes through the library whole.
    """

    CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch
    WORD_END = b"\xff"

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path} cuts texts in steps that are not known here: {steps}")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search
        back, end = {c: b for b, c in enumerate(byte_characters())}, spec["model"]["end_of_word_suffix"]
        whole = lambda t: bytes(map(back.__getitem__, t.removesuffix(end))) + (self.WORD_END if t.endswith(end) else b"")
        ranks = {whole(t): i for t, i in spec["model"]["vocab"].items()}
        self.merge = tiktoken.Encoding("terravox-words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= KNOWN:
                self.parts.clear()
            ids = self.merge(part.encode() + self.WORD_END)
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.PLAIN(text) and not self.added(text):
            return b"".join(map(self._part, self.CUT.findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: bytes | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = (text or b"").split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            if len(self.words) >= KNOWN:
                self.words.clear()
            for w in set(words).difference(self.words):
                self.words[w] = self.word(w)
            return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, ids_crc32); ids are empty unless with_ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path).text
        for batch in batches:
            rows, times = [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text) + end
                cuts = range(0, len(ids), 4 * limit)
                for k, at in enumerate(cuts):
                    piece = ids[at : at + 4 * limit]
                    rows.append((k, at // 4, len(piece) // 4, np.frombuffer(piece, "<i4") if with_ids else [], zlib.crc32(piece)))
                times.append(len(cuts))
            doc_id = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(times)), times)))
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()
            columns = zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)
            yield pa.record_batch([doc_id, *(pa.array(v, kind) for v, kind in columns)], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(cast(text as string) as binary) text")
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long")


def best_fit(lengths: list[int], limit: int = LIMIT, open_bins: int = OPEN) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each length in turn, bins' used space, and the bins still open at the end.

    Bit f of `room` is set while an open bin has f places free: the lowest set bit from a length on is the best fit, and the
    lowest of all is the fullest bin.
    """
    bins, offsets, used = [], [], []
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    room = opened = 0
    for n in lengths:
        fits = room >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                room ^= 1 << f
        else:
            if opened == open_bins:
                f = (room & -room).bit_length() - 1
                free[f].pop()
                if not free[f]:
                    room ^= 1 << f
                opened -= 1
            b, f = len(used), limit
            used.append(0)
            opened += 1
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        f -= n
        if f:
            free[f].append(b)
            room |= 1 << f
        else:
            opened -= 1
    return bins, offsets, used, [b for held in free for b in held]


def _round(limit: int, open_bins: int, level: int):
    """Pack the items of a group; an item that lands in a bin still open at the end says so."""

    def run(group: pa.Table) -> pa.Table:
        item, length, part = (group.column(c).to_numpy() for c in ("item", "length", "part"))
        order = np.lexsort((item, item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))  # any order but that of the table
        bins, offsets, used, still = best_fit(length[order].tolist(), limit, open_bins)
        number = (np.int64(level) << 56) + (part[0].astype(np.int64) << 24) + np.array(bins, np.int64)
        return pa.table({"item": item[order], "bin": number, "at": np.array(offsets, np.int64), "used": np.array(used, np.int64)[bins], "is_open": np.isin(bins, still)})

    return run


def assign(items: DataFrame, limit: int = LIMIT, open_bins: int = OPEN, group: int = GROUP) -> DataFrame:
    """(item, sequence_id, offset) of items (item long, length long), each item a number of its own.

    Rounds: a group's bins that are still open go on as items of the next round; a round has a fraction of the items of the
    one before, at most open_bins for each group of at least eight times as many.
    """
    group = max(group, 8 * open_bins)
    rounds, level = [], 0
    while True:
        groups = -(-max(items.count(), 1) // group)
        part = F.pmod(F.xxhash64("item"), F.lit(groups)).alias("part")
        packed = items.select("item", "length", part).groupBy("part").applyInArrow(_round(limit, open_bins, level), "item long, bin long, at long, used long, is_open boolean")
        if groups == 1:
            rounds.append(packed)
            break
        packed = materialize(packed, f"packed-{level}")
        rounds.append(packed)
        items, level = packed.where("is_open").groupBy(F.col("bin").alias("item")).agg(F.max("used").alias("length")), level + 1
    placed = rounds.pop().selectExpr("item", "bin sequence_id", "at offset")
    for packed in reversed(rounds):  # a bin that was packed again lends its place to what it holds
        inner = packed.join(placed.withColumnsRenamed({"item": "bin"}), "bin", "left")
        placed = inner.selectExpr("item", "coalesce(sequence_id, bin) sequence_id", "at + coalesce(offset, 0) offset")
    return placed


def pack(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; pieces are written once, so that no text is encoded twice and each keeps its place."""
    cut = materialize(pieces(docs, path, limit, with_ids=with_ids).withColumn("item", F.monotonically_increasing_id()), "bestfit-pieces")
    placed = assign(cut.select("item", "length"), limit)
    return cut.join(placed, "item").select("doc_id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
