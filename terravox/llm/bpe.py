"""Operator 4: byte-level BPE through a sentencepiece model that is serialised here from the vocabulary.

A rank file becomes a sentencepiece ModelProto: each token's bytes are written one character a byte, its score is the
negative rank, and normalisation is the identity. Sentencepiece's BPE then joins the adjacent pair of the best score,
leftmost first, which is byte-level BPE's rule. Texts are cut into pre-tokens, each encoded separately; ids are decoded
by the inverse of the byte map.

Null and empty texts have no ids. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: A worker forgets its known pre-tokens beyond this many; they are then encoded again.
KNOWN_PRETOKENS = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, otherwise the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """ModelProto of the vocabulary; the id of a piece is its rank, and one unknown piece follows."""
    table = {b: c for b, c in enumerate(byte_characters())}
    pieces = [_field(1, t.decode("latin-1").translate(table).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.cut = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters()))
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def pretoken(self, word: str) -> bytes:
        """Ids of one pre-token, little-endian; a pre-token that is a token is that token."""
        raw = word.encode("utf-8", "surrogatepass")
        rank = self.whole.get(raw)
        ids = self.pieces.encode(raw.decode("latin-1").translate(self.table)) if rank is None else [rank]
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        words, known = self.cut(text or ""), self.known
        if len(known) > KNOWN_PRETOKENS:
            known.clear()
        try:
            ids = b"".join(map(known.__getitem__, words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = self.pretoken(w)
            ids = b"".join(map(known.__getitem__, words))
        return np.frombuffer(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one per row of docs; ids are empty unless with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text)
                rows.append((len(ids), ids.astype(np.int32) if with_ids else [], hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            columns = zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string()), strict=True)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, kind) for v, kind in columns)], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).drop("ids")
