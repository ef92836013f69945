"""Best-fit packing against the tokenizers library and a plain packer."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import public_tokenizers as P
from terravox.llm import bestfit, common

from .test_corpus import empty, odd

PATH = P.path("word_bpe_49k.json")
ODD_WORDS = [
    "", "  ", "Hello WORLD it's don't I'LL 'S", "é ́a  x́", "İstanbul ΣΑΣ ΌΣΟΣ ß ﬁ", "a\xa0b c\x85d\x1ce\x1ff\vg\fh", "x<|endoftext|>y <|endoftext|> <|startoftext|><|endoftext|>", "<|endof text|>", "\x00\x01a\x02", "123 4a5 a'b ''s's 'tis",
    "漢字かな 😀👍🏽 x😀", "a​b‍", "Å Å ﷺ ẛ̣", "don’t ‘ok’", "1²2 ½ Ⅷ", "'RE we're ÀÉ×÷ÿÞ", "ǅ ǆ µªº", "<|ENDOFTEXT|> é<|endoftext|>",
]


def test_words_have_the_ids_of_the_library():
    ours = bestfit.WordIds(PATH)
    rng = random.Random(5)
    texts = ODD_WORDS + ["".join(rng.choice("abcdefghiéüÖst'ntw#9 ") for _ in range(40)) for _ in range(3000)]
    for text, want in zip(texts, ours.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ours.text(text.encode()), "<u4").tolist() == want.ids, text


def plain_best_fit(lengths, limit, open_bins):
    """The same law by looking at all open bins each time; of bins that are equally full the youngest at that fill."""
    opened, used, out = [], [], []
    for n in lengths:
        fitting = [b for b in opened if used[b] + n <= limit]
        if fitting:
            b = max(fitting, key=lambda b: (used[b], opened.index(b)))
            opened.remove(b)
        else:
            if len(opened) == open_bins:
                opened.remove(max(opened, key=lambda b: (used[b], opened.index(b))))
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        if used[b] < limit:
            opened.append(b)
    return out


def test_bitset_against_a_plain_search():
    rng = random.Random(3)
    for limit, open_bins in ((16, 3), (64, 1), (64, 10), (2048, 40)):
        for _ in range(20):
            lengths = [min(limit, 1 + int(rng.expovariate(4 / limit))) for _ in range(300)]
            bins, offsets, used, still = bestfit.best_fit(lengths, limit, open_bins)
            assert list(zip(bins, offsets, strict=True)) == plain_best_fit(lengths, limit, open_bins)
            assert max(used) <= limit and len(still) <= open_bins


def whole(rows, limit):
    """Sequences without gaps or overlaps, none over the limit; their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_whole_table(spark, sf):
    docs = common.documents(spark, sf)
    got = bestfit.pack(docs, PATH).collect()
    library, by = bestfit.WordIds(PATH).library, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        rows = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in rows] == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert whole(got, 2048) <= 1.1 * sum(r.length for r in got) / 2048 + 1


def test_rounds_leave_no_half_empty_bins(spark):
    """Many groups with many bins still open: rounds pack those again."""
    rng = random.Random(9)
    items = spark.createDataFrame([(k, rng.randint(1, 60)) for k in range(4000)], "item long, length long")
    got = bestfit.assign(items, 64, 8, 64).join(items, "item").collect()
    assert len(got) == 4000 == len({r.item for r in got})
    assert whole(got, 64) <= 1.12 * sum(r.length for r in got) / 64


def test_odd_tables(spark):
    got = bestfit.pack(odd(spark), PATH, with_ids=True).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd(spark).collect()}
    assert sum(r.doc_id == 5 for r in got) == 2 and [r.ids for r in got if r.doc_id in (1, 2, 3)] == [[0]] * 3
    whole(got, 2048)
    assert bestfit.pack(empty(spark), PATH).count() == 0
    again = bestfit.pack(odd(spark).withColumn("item", F.lit(1)), PATH).collect()
    assert len(again) == len(got)
