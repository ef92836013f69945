"""Operator 13: words of a corpus that differ by one edit, grouped under their most frequent form.

Words are counted by tasks on whole columns of text: runs of letters become one Arrow column per few megabytes, a
dictionary of it has each distinct run once, and the checksum that decides on a deleted letter is put together from those of
a document's id and of a run.

Near words are found by a positional q-gram index. A pair of which the shorter word has n letters is cut at the same places,
counted from the front before the edit and from the back after it, so that all but the damaged segment agree: words are dealt
to shards of the index by what agrees, first by three quarters of a word. Shards of more than SHARD words are dealt again with
segments of half the length, down to single letters, where the alphabet bounds a shard; so shards stay small, whatever
the vocabulary. In a shard, q-grams of the damaged segment point to the words of n letters that have them at a place; the
postings of a word's q-grams, one place to either side, are merged by a heap, and words met as often as an edit of one letter
leaves q-grams in common are compared letter by letter. A pair that agrees in several shards counts in the first alone.

Null and empty texts have no words; a null id counts as empty text. Repeated rows are counted each. Of near words with equal
counts the smallest in code-point order is the form. Empty tables give no words; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize

#: Code points and occurrences that a word has at least; one run in DAMAGE loses a letter.
LETTERS, TIMES, DAMAGE = 5, 3, 97
#: Bytes of text that are counted at a time, and length up to which checksums come from a table.
CHUNK, NEAR_BYTES = 4 << 20, 48
#: Words in a shard beyond which it is cut finer, letters of a gram, and halvings of a word to begin with.
SHARD, Q, HALVINGS = 128, 2, 2

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), 0xC3])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """(id and colon, text) of some megabytes in all; a longer text is cut at spaces."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            head, lo = b"%d:" % doc_id if doc_id is not None else b":", 0
            while text and lo < len(text):
                hi = len(text) if len(text) - lo <= CHUNK else text.rfind(b" ", lo + 1, lo + CHUNK)
                hi = hi if hi > 0 else text.find(b" ", lo + CHUNK)
                hi = hi if hi > 0 else len(text)
                held.append((head, text[lo:hi]))
                size, lo = size + hi - lo, hi
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def count_chunk(chunk: list[tuple[bytes, bytes]]) -> tuple[pa.Array, np.ndarray, Counter]:
    """Runs of at least LETTERS code points as they stand with their counts, and those that lost a letter."""
    data = np.frombuffer(b"\n".join(text.lower() for _, text in chunk) + b"\n", np.uint8)
    inside = LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0], edge]) if inside[0] else edge
    starts, ends = edge[::2], edge[1::2]
    wide = np.cumsum(data == 0xC3)
    points = ends - starts - (wide[ends - 1] - wide[starts] + (data[starts] == 0xC3))
    kept = points >= LETTERS
    starts, ends, points = starts[kept], ends[kept], points[kept]
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), Counter()
    doc = np.searchsorted(np.cumsum([len(text) + 1 for _, text in chunk]), starts, "right")
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    letters = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    known, code = runs.dictionary.to_pylist(), runs.indices.to_numpy()
    # crc32(a + b) is crc32(a), moved on by len(b) bytes of zero, xor crc32(b).
    moved = np.empty((NEAR_BYTES + 1, len(chunk)), np.uint32)
    moved[0] = [zlib.crc32(head) for head, _ in chunk]
    for k in range(NEAR_BYTES):
        moved[k + 1] = CRC[moved[k] & 255] ^ (moved[k] >> 8)
    crc = moved[np.minimum(sizes, NEAR_BYTES), doc] ^ np.array([zlib.crc32(w) for w in known], np.uint32)[code]
    for k in np.flatnonzero(sizes > NEAR_BYTES):
        crc[k] = zlib.crc32(known[code[k]], zlib.crc32(chunk[doc[k]][0]))
    hit = crc % DAMAGE == 0
    lost = Counter()
    for w, h in zip(code[hit].tolist(), crc[hit].tolist(), strict=True):
        word = known[w].decode()
        at = h % len(word)
        if len(word) > LETTERS:
            lost[word[:at] + word[at + 1 :]] += 1
    times = np.bincount(code[~hit], minlength=len(known))
    seen = np.flatnonzero(times)
    return runs.dictionary.take(pa.array(seen)), times[seen], lost


def vocabulary(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """Rows (word, n) of words with at least LETTERS code points and so many occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            word, n, lost = count_chunk(chunk)
            word = pa.concat_arrays([word.cast(pa.string()), pa.array(list(lost), pa.string())])
            yield pa.record_batch([word, pa.array(np.concatenate([n, np.array(list(lost.values()), np.int64)]))], names=["word", "n"])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(cast(text as string) as binary) text")
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _dealt(words: DataFrame, halvings: int, parent: Column | None = None) -> DataFrame:
    """Rows (shard, ref, segment, word, n): what a word agrees in with near words, of which the shorter has `ref` letters.

    With parent, words carry the ref and segment of a shard that is cut in two.
    """
    length = F.length("word")
    if parent is None:
        words = words.withColumn("ref", F.explode(F.filter(F.array(length, length - 1), lambda x: x >= LETTERS)))
        words = words.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit((1 << halvings) - 1))))
    else:
        words = words.withColumn("segment", F.explode(F.array(2 * F.col("segment"), 2 * F.col("segment") + 1)))
    cut = lambda k: F.shiftright(k.cast("long") * F.col("ref"), halvings).cast("int")
    head, tail = cut(F.col("segment")), F.col("ref") - cut(F.col("segment") + 1)
    agreed = F.xxhash64("ref", "segment", F.left("word", head), F.right("word", tail))
    return words.select(agreed.alias("shard"), "ref", "segment", "word", "n")


def within_one(a: str, b: str) -> bool:
    """Whether a becomes b by exactly one replaced letter, or by one more letter."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def _grams(part: str) -> list[str]:
    part = "\0" * (Q - 1) + part + "\1" * (Q - 1)
    return [part[k : k + Q] for k in range(len(part) - Q + 1)]


def shard_pairs(words: list[tuple[str, int]], ref: int, segment: int, halvings: int) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs (word, n, word, n) of a shard: of two words of ref letters, or of one with one of a letter more."""
    lo, hi = segment * ref >> halvings, (segment + 1) * ref >> halvings
    tail = ref - hi
    index: dict[tuple[str, int], list[int]] = {}
    short: list[tuple[str, int]] = []
    for number, (word, n) in enumerate(sorted(words, key=lambda w: (len(w[0]), w[0]))):
        grams = _grams(word[lo : len(word) - tail])
        # One edit of a segment of s letters leaves all but Q of its s + Q - 1 grams, at their place or one beside it.
        bound = len(grams) - Q
        if bound > 0:
            postings = [index[g, p] for k, g in enumerate(grams) for p in (k - 1, k, k + 1) if (g, p) in index]
            met = (m for m, same in groupby(merge(*postings)) if bound == 1 or sum(1 for _ in same) >= bound)
        else:
            met = range(len(short))
        for m in met:
            other, n_other = short[m]
            if within_one(other, word):
                back = 0
                while back < ref and other[-1 - back] == word[-1 - back]:
                    back += 1
                if back >= tail and other[:lo] == word[:lo] and (segment == 0 or lo < ref - back):
                    yield other, n_other, word, n
        if len(word) == ref:
            for k, g in enumerate(grams):
                index.setdefault((g, k), []).append(number)
            short.append((word, n))


def _pairs_of(halvings: int):
    """Arrow pass over rows that are sorted by shard; a shard may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        found: list[tuple[str, int, str, int]] = []

        def flush(limit: int) -> Iterator[pa.RecordBatch]:
            if len(found) > limit:
                a, m, b, n = zip(*found, strict=True)
                found.clear()
                yield pa.record_batch([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(n + m, pa.int64())], names=["word", "near", "near_n"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "ref", "segment", "word", "n"))
            for shard, ref, segment, word, n in zip(*columns, strict=True):
                if (shard, ref, segment) != last:
                    if len(held) > 1:
                        found.extend(shard_pairs(held, *last[1:], halvings))
                    held, last = [], (shard, ref, segment)
                held.append((word, n))
            yield from flush(10_000)
        if len(held) > 1:
            found.extend(shard_pairs(held, *last[1:], halvings))
        yield from flush(0)

    return run


def near_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (word, near, near_n), both ways, of words (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    rows, halvings, out = _dealt(words, HALVINGS), HALVINGS, None
    while True:
        rows = materialize(rows, f"shards-{halvings}")
        large = materialize(rows.groupBy("shard").count().where(F.col("count") > shard).select("shard"), f"large-{halvings}")
        finer = (1 << halvings) < longest and not large.isEmpty()
        small = rows.join(large, "shard", "left_anti") if finer else rows
        dealt = small.repartition("shard").sortWithinPartitions("shard", "ref", "segment")
        pairs = dealt.select("shard", "ref", "segment", "word", "n").mapInArrow(_pairs_of(halvings), "word string, near string, near_n long")
        out = pairs if out is None else out.unionByName(pairs)
        if not finer:
            return out
        rows, halvings = _dealt(rows.join(large, "shard", "left_semi"), halvings + 1, F.col("segment")), halvings + 1


def variants(docs: DataFrame, times: int = TIMES, shard: int = SHARD, ratio: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all words."""
    words = materialize(vocabulary(docs, times), "vocabulary")
    best = near_pairs(words, shard).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    rows = materialize(rows, "forms")
    # A form has at least `ratio` times the count, so chains end; each round doubles the steps that are behind.
    ahead = rows.where("form is not null").selectExpr("word", "form root")
    while True:
        further = ahead.join(ahead.selectExpr("word root", "root further"), "root", "left").selectExpr("word", "coalesce(further, root) root", "further is not null moved")
        further = materialize(further, "roots")
        ahead = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return rows.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
