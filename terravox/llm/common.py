"""Helpers that the corpus operators share: words, folds, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of the word separators: space and the control characters tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() cuts at exactly the separators above. Null: no words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Rising distinct values: by sorting, which is faster here than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def order_of(key: np.ndarray) -> np.ndarray:
    """Places of 64-bit keys by rising key.

    Places take the low bits of the keys for a plain sort, several times faster than argsort; where the bits that this
    leaves of a key do not tell keys apart, argsort has to.
    """
    bits = np.uint64(len(key).bit_length())
    if bits <= 24:
        order = (np.sort((key >> bits << bits) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        rising = key[order]
        if (rising[1:] >= rising[:-1]).all():
            return order
    return np.argsort(key, kind="stable")


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct values, and the place among them of each value."""
    order = order_of(x)
    rising = x[order]
    new = np.concatenate([[True], rising[1:] != rising[:-1]])
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return rising[new], place


#: Bytes of a word up to this place are looked up, further ones are computed.
PLACES = 64
BYTES = np.arange(256, dtype=np.uint64)
IS_WORD = ~np.isin(BYTES, [32, *range(9, 14)])
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + np.uint64(32), BYTES)


@lru_cache(maxsize=2)
def _byte_hashes(lower: bool) -> np.ndarray:
    place = np.arange(PLACES, dtype=np.uint64)[:, None] << np.uint64(8)
    return mixed((place + (LOWER if lower else BYTES) + np.uint64(1)) * MIX).ravel()


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, end to end, and each text's number of words.

    A word's hash is the finalised sum of random numbers, one for each byte at its place: whole texts are cut and hashed
    by array operations. With lower, A-Z count as a-z.
    """
    sizes = np.zeros(len(texts), np.int64)
    out, table = [], _byte_hashes(lower)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 17):
            size += len(texts[hi]) + 1
            hi += 1
        data = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
        word = IS_WORD[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.concatenate([[0], edge]) if word[0] else edge
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        ends = np.cumsum(np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo) + 1)
        sizes[lo:hi] = np.diff(np.searchsorted(starts, ends), prepend=0)
        lo = hi
        if not len(starts):
            continue
        first = np.cumsum(lengths) - lengths
        letters = data[word]
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        value = table[np.minimum(place, PLACES - 1) << 8 | letters]
        if lengths.max() > PLACES:
            far = np.flatnonzero(place >= PLACES)
            letter = (LOWER if lower else BYTES)[letters[far]]
            value[far] = mixed(((place[far].astype(np.uint64) << np.uint64(8)) + letter + np.uint64(1)) * MIX)
        out.append(mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64) * MIX))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def by_range(key: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, where its keys are) of rising keys: bucket b holds the b-th of equal shares of all 64-bit keys."""
    share = np.uint64(2**64 // buckets + 1)
    cuts = np.searchsorted(key, np.arange(1, buckets, dtype=np.uint64) * share).tolist()
    return [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(key)])) if hi > lo]


def words_column(text: Column | str) -> Column:
    """The same words as an array column, without Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable can be indexed inside further lambdas at no cost."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor of a cluster reaches; a temporary folder only on one machine, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="terravox-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_to
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def literal_array(values, kind: str) -> Column:
    """A bounded list of numbers as a constant of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def pack(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, no more than the largest needs: small ones compress well."""
    a = np.ascontiguousarray(a, dtype="<u8")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()
