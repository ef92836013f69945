"""Operator 12: fill-in-middle with a sparse index of checkpoints.

A unit is a word with the separators before it, or separators at the end of a text. While the units of a text are
counted, the byte and code-point offsets after every STEP-th are kept. A cut after so many units starts at the last
checkpoint before it, found by binary search, and scans fewer than STEP units on. Which form a document gets and where it is
cut comes from a hash of its id, so a run can be repeated and each row stands alone.

Null text counts as empty. Empty texts, and texts that hold one of the marks, stay as they are. A null id is hashed as
empty text. Repeated rows get equal results; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import IS_WORD, documents

#: Units between checkpoints, and bytes that are counted at a time.
STEP, BLOCK = 64, 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Units:
    """Number of units of a UTF-8 text, and where any of them ends."""

    def __init__(self, text: bytes, step: int = STEP, block: int = BLOCK) -> None:
        self.text = text
        self.counts, self.at, self.chars = [0], [0], [0]
        n = chars = 0
        for lo in range(0, len(text), block):
            data = np.frombuffer(text, np.uint8, min(block, len(text) - lo), lo)
            word = IS_WORD[data]
            follows = lo + len(data) < len(text) and IS_WORD[text[lo + len(data)]]
            ends = np.flatnonzero(word & ~np.append(word[1:], follows)) + 1
            kept = ends[step - 1 - n % step :: step]
            begins = np.cumsum((data & 0xC0) != 0x80)
            if len(kept):
                first = n - n % step + step
                self.counts.extend(range(first, first + step * len(kept), step))
                self.at.extend((kept + lo).tolist())
                self.chars.extend((begins[kept - 1] + chars).tolist())
            n, chars = n + len(ends), chars + int(begins[-1])
        self.n = n + bool(text and not IS_WORD[text[-1]])

    def end(self, units: int) -> tuple[int, int]:
        """Byte and code-point offset after so many units."""
        k = bisect_right(self.counts, units) - 1
        at = self.at[k]
        for _ in range(units - self.counts[k]):
            at = UNIT.match(self.text, at).end()
        return at, self.chars[k] + sum(b & 0xC0 != 0x80 for b in self.text[self.at[k] : at])


def drawn(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: bytes, doc_id: int | None, rate: int, spm: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output)."""
    units, (h1, h2, h3, h4) = Units(text), drawn(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.n, "plain", None, None, text
    (a, chars_a), (b, chars_b) = (units.end(h) for h in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, output = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, output = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return units.n, form, chars_a, chars_b - chars_a, output


def restore(output: bytes, form: str) -> bytes:
    """The text again; each mark occurs once in an output that is not plain."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, rest = output.removeprefix(first).split(second)
    tail, middle = rest.split(MIDDLE)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, with_output: bool = True) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256), one per row of docs; output is null unless with_output.

    Of 100 documents about `rate` are rearranged, of 100 of those about `spm` suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                *facts, output = transform(text or b"", doc_id, rate, spm, seed)
                digest = hashlib.sha256(output).hexdigest()
                restored = digest if facts[1] == "plain" else hashlib.sha256(restore(output, facts[1])).hexdigest()
                rows.append((*facts, output if with_output else None, digest, restored))
            columns = zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, kind) for v, kind in columns)], names=NAMES)

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(cast(text as string) as binary) text")
    made = docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string, restored_sha256 string")
    return made.withColumn("output", made["output"].cast("string"))


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir), with_output=False).drop("output")


def oracle() -> str:
    """DuckDB SQL of the same rows."""
    group = lambda k: f"('0x' || substr(digest, {8 * k - 7}, 8))::ubigint"
    return rf"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id::varchar) as digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
cuts as (
  select *, len(u)::bigint as n, least({group(1)} % (len(u) + 1)::ubigint, {group(2)} % (len(u) + 1)::ubigint)::bigint as a,
         greatest({group(1)} % (len(u) + 1)::ubigint, {group(2)} % (len(u) + 1)::ubigint)::bigint as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {group(3)} % 100 >= 50 then 'plain'
              when {group(4)} % 100 < 80 then 'spm' else 'psm' end as form
  from units),
parts as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix
  from cuts)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts"""
