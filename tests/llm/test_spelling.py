"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terravox.llm import common, spelling

from .test_corpus import empty, odd

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows, letters=5, times=3):
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= letters and n >= times}


def shortened(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def near(words):
    """All near words of each: equal after a deletion from one, or from both at one place."""
    by, out = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            by.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    for same in by.values():
        for w in same:
            out[w] |= same - {w}
    for w in words:
        for v in shortened(w) & words.keys():
            out[w].add(v)
            out[v].add(w)
    return out


def brute(rows):
    words, out = counted(rows), {}
    close = near(words)
    form = {w: min(close[w], key=lambda v: (-words[v], v)) for w in words if close[w]}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in common.documents(spark, sf).select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(spelling.query(spark, sf)) == want and len(want) > 500


def test_within_one():
    near_words = [("abcde", "abxde"), ("abcde", "abcdef"), ("abcde", "xabcde"), ("aabbb", "aaabbb"), ("abcde", "abcxde")]
    far = [("abcde", "abcde"), ("abcde", "abdce"), ("abcde", "axcye"), ("abcde", "xbcdef"), ("aaaaa", "aaaabb")]
    assert all(spelling.within_one(*p) for p in near_words) and not any(spelling.within_one(*p) for p in far)


@pytest.mark.parametrize(("alphabet", "shard"), [("ab", 2), ("ab", 16), ("abé", 8), ("abcdefgh", 4)])
def test_every_pair_once_in_shards_of_all_sizes(spark, alphabet, shard):
    """Words of few letters, in which runs make an edit possible at several places, and shards that are cut to single letters."""
    rng = random.Random(len(alphabet) * shard)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice((5, 6, 7, 8, 13)))): 3 for _ in range(500)}
    pairs = [(r.word, r.near) for r in spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), shard).collect()]
    assert sorted(pairs) == sorted((w, v) for w, vs in near(words).items() for v in vs)


def test_shards_grow_no_pairs_with_their_square():
    """The index compares few of the pairs of a family of long words with a common stem."""
    rng = random.Random(1)
    family = sorted({"stem" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)})
    compared = Counter()
    before = spelling.within_one
    try:
        spelling.within_one = lambda a, b: compared.update(["pairs"]) or before(a, b)
        assert not list(spelling.shard_pairs([(w, 3) for w in family], 16, 0, 0))
    finally:
        spelling.within_one = before
    assert compared["pairs"] < 0.01 * len(family) ** 2


def test_forms_and_roots(spark):
    """A chain, ties, counts just below and at the ratio, runs of odd letters, and a word longer than the checksum table."""
    long = "x" * 60
    texts = ["colour " * 12, "color " * 25, "colors " * 60, "Colorz " * 3, "þorns×÷ " * 3, "þorns×÷a " * 5, f"{long} " * 9, f"{long}y " * 3, "abcde " * 8, "abcdf " * 8, "abcdg " * 4, "tiny " * 9, "grey2gray " * 5]
    rows = [(k * 100 + j, t) for j in range(3) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(spelling.variants(df))
    assert out == brute(rows)
    assert out["colour"][1] == "colors" and out["abcdg"][0] == "abcde" and out["abcdf"][0] is None


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join("".join(rng.choice("abcé") for _ in range(5)) for _ in range(400))) for k in range(8)] + [(9, "z" * 3000 + " " + "abcab " * 300), (None, "abcab" * 500)]
    want = Counter()
    monkeypatch.setattr(spelling, "CHUNK", 700)
    batch = __import__("pyarrow").record_batch({"doc_id": [i for i, _ in rows], "text": [t.encode() for _, t in rows]})
    for chunk in spelling._chunks(iter([batch])):
        word, n, lost = spelling.count_chunk(chunk)
        want.update(dict(zip((w.decode() for w in word.to_pylist()), n.tolist(), strict=True)))
        want.update(lost)
    assert {w: n for w, n in want.items() if n >= 3} == counted(rows)


def test_odd_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert got(spelling.variants(odd(spark).withColumns({"word": F.col("text"), "n": F.col("doc_id")}))) == brute(rows)
    assert spelling.variants(empty(spark)).count() == 0
