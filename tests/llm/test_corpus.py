"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from terravox.llm import bpe, common, doubling, jaccard, licenses, packing, pitman_yor, quality, sharding, toxicity, webp

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, block string, words int"


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{k % 977} x{k % 31}" for k in range(30_000))
    same = "one two three four five six " * 12
    rows = [(1, None), (None, "a text without an id " * 4), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (6, same + "seven"), (7, long), (8, long + " end"), (9, "é ü 漢字 😀 <|endoftext|> $5 it's"), (10, "b"), (2**60 + 1, "an id that no double holds")]
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, "k", "b", 1) for i, t in rows], ODD)


def empty(spark):
    return odd(spark).where("false")


def words(text):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], LABELS)


ALL = {
    "op1": lambda d, lab: pitman_yor.scores(d), "op2": lambda d, lab: toxicity.score(d, toxicity.train(d, lab)), "op3": lambda d, lab: jaccard.join(d), "op4": lambda d, lab: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "op5": lambda d, lab: licenses.scan(d, licenses.known(d.sparkSession)), "op6": lambda d, lab: webp.read(webp.store(d)), "op7": lambda d, lab: sharding.shard(d)[0], "op8": lambda d, lab: doubling.dedup(d, carry=True), "op9": lambda d, lab: quality.judge(d, lab),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_and_empty_tables(spark, labels, name):
    got = ALL[name](odd(spark), labels)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in odd(spark).select("doc_id").collect())
    assert ALL[name](empty(spark), labels).count() == 0


def test_packing_of_odd_tables(spark):
    pieces = packing.pack(odd(spark), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd(spark).collect()}
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in pieces)
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


# 1


def test_pitman_yor_counts_and_scores(spark, sf):
    rows = common.documents(spark, sf).select("doc_id", "text").collect()
    tokens = {r.doc_id: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(r.text)] + [None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in pitman_yor.scores(common.documents(spark, sf)).collect()}
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(count[t] > 0 for t in ts), n)
        assert abs(r.base_score - sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) < 1e-6 * len(ts)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_pitman_yor_probabilities_sum_to_one():
    """Over all words and the unknown one, of each context and of an unseen one."""
    import pyarrow as pa

    texts = ["a b a b c", "b b c a", "a c", ""]
    table = pa.table({"doc_id": [0, 1, 2, 3], "text": texts, "held_out": [False] * 4, "block": [0] * 4})
    probe = [f"{u} {w}" for u in ("a", "b", "c", "zz") for w in ("a", "b", "c", "zz")]
    table = pa.concat_tables([table, pa.table({"doc_id": list(range(10, 10 + len(probe))), "text": probe, "held_out": [True] * len(probe), "block": [0] * len(probe)})])
    docs = pa.concat_tables([pa.Table.from_batches([b]) for b in pitman_yor._deal(iter(table.combine_chunks().to_batches()))])
    first, later = pitman_yor._asks(4)
    asked, replies = first(docs), None
    for _ in range(4):
        rows = [r for k, b in sorted({(r["kind"], r["bucket"]) for r in asked.to_pylist()}) for r in pitman_yor._reply(asked.filter(pa.array([(x["kind"], x["bucket"]) == (k, b) for x in asked.to_pylist()]))).to_pylist()]
        sums = {k: [sum(r[f"s{j}"] for r in rows if r["kind"] == k and r["block"] < 0) for j in range(4)] for k in {r["kind"] for r in rows}}
        told = [{**r, **{f"s{j}": sums[r["kind"]][j] for j in range(4)}} for r in rows if r["block"] >= 0]
        replies = told if replies is None else replies + told
        asked = later(docs, pa.Table.from_pylist(replies))
    block = pitman_yor.Block(docs)
    known = pitman_yor.Replay(block, replies, 4, False)
    mean = sum(known.predictive) / len(known.predictive)
    end, by = int(np.flatnonzero(block.words == pitman_yor.END)[0]), {}
    for u, w, p in zip(block.context, block.word, mean, strict=True):
        by.setdefault(int(u), {})[int(w)] = p
    full = [ps for ps in by.values() if len(ps) == 5 and end in ps]
    assert full and all(abs(sum(ps.values()) - 1) < 1e-9 for ps in full)


def test_table_counts_follow_their_weights():
    rng = np.random.default_rng(1)
    # Customers, weights of opening, and how far the mean number of tables may be off: exact up to EXACT, close beyond.
    for d, c, a, off in ((0.6, 4, 0.8, 0.01), (0.6, 200, 2.0, 0.02), (0.3, 800, 8.0, 0.02), (0.6, 2000, 8.0, 0.02), (0.9, 2000, 1.0, 0.02), (0.5, 2000, 40.0, 0.04)):
        n = 20_000
        t = pitman_yor.seat(np.full(n, float(c)), np.full(n, a), rng.integers(0, 2**63, n).astype(np.uint64), 3, d)
        weight = pitman_yor.stirling(d, max(c, 2))[c, 1:] + np.arange(1, max(c, 2) + 1) * np.log(a)
        weight = np.exp(weight - weight.max())
        mean = (weight * np.arange(1, len(weight) + 1)).sum() / weight.sum()
        assert abs(t.mean() - mean) < off * mean, (d, c, a)
        if c <= pitman_yor.EXACT:
            assert np.abs(np.bincount(t.astype(int), minlength=c + 1)[1 : c + 1] / n - weight[:c] / weight.sum()).max() < 0.015
    for shape in (0.3, 7.5):
        x = pitman_yor.gamma(np.full(50_000, shape), rng.integers(0, 2**63, 50_000).astype(np.uint64), 5)
        assert abs(x.mean() - shape) < 0.03 * shape and abs(x.var() - shape) < 0.06 * shape


# 2


def test_toxicity_on_held_out_words(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(["river", "stone", "garden", "winter", "morning", "paper"], 20)) for _ in range(300)]
    rude = ["grobnak", "snivelit", "vurmhead"]
    twist = lambda w: w[:3] + w[3] * 2 + w[4:]
    rows = [(k, t if k % 2 else t + " " + (rude[k % 3] if zlib.crc32(str(k).encode()) % 3 != 1 else twist(rude[k % 3])), 1 - k % 2) for k, t in enumerate(clean)]
    docs, lab = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.95


# 3


def test_toxicity_scores_against_brute_force(spark):
    """Each word's mean share of the margin, the worst word of a text, and the logistic of it, one n-gram after the other."""
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32), rng.normal(size=(toxicity.DIMENSIONS, 2)).astype(np.float32), np.array([0.3, -0.2], np.float32), 0.7, -0.1)
    mask = (1 << 64) - 1

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ c) * 0x9E3779B97F4A7C15) & mask
            h ^= h >> 29
        return h % toxicity.BUCKETS

    def margin(word):
        raw = b"<" + word.lower().encode() + b">"
        bag = np.mean([model.embeddings[bucket(raw[k : k + n])] for n in toxicity.NGRAMS for k in range(len(raw) - n + 1)], axis=0)
        out = bag @ model.outputs + model.bias
        return 0.7 * float(out[1] - out[0]) - 0.1

    empty_text = 0.7 * float(model.bias[1] - model.bias[0]) - 0.1
    rows = odd(spark).where("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text")
    for r in toxicity.score(rows, model).collect():
        worst = max((margin(w) for w in words(r.text)), default=empty_text)
        assert abs(r.score - 1 / (1 + math.exp(-worst))) < 1e-5


@pytest.mark.parametrize("width,threshold", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, sf, width, threshold):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()]
    base = [words(t) for _, t in rows[:20]]
    for k, ws in enumerate(base):  # copies with a few words changed
        for c in range(3):
            ws = list(ws)
            for at in rng.choice(len(ws), max(1, len(ws) // 60 * c), replace=False) if ws else []:
                ws[at] = f"new{at}"
            rows.append((10_000 + 10 * k + c, " ".join(ws)))
    rows += [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "ONE two")]
    sets = {}
    for i, t in rows:
        ws = [w.lower() for w in words(t)]
        sets[i] = {tuple(ws[k : k + min(width, len(ws))]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold, width).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,threshold", [(3, 90), (5, 80)])
def test_near_copies_of_all_sizes_are_linked(spark, width, threshold):
    rows, want = [], {}
    for n in [*range(width, 60), *range(120, 146), 700, 3000]:  # pairs of n words and as many more as the threshold allows, and one more
        most = (n - width + 1) * 100 // threshold - (n - width + 1)
        ws = [f"d{n}w{k}" for k in range(n)]
        for j, extra in enumerate((0, most, most + 1)):
            rows.append((10 * n + j, " ".join([*ws, *(f"d{n}x{j}y{k}" for k in range(extra))])))
        want |= {10 * n: 10 * n, 10 * n + 1: 10 * n, 10 * n + 2: 10 * n + 2}
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold, width).collect()}
    assert got == want


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for threshold in (90, 80):
        for n in (1, 2, 5, 9, 10, 40, 61, 128, 129, 400, 2500):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            for gone in range(0, n * (100 - threshold) // 100 + 1, max(1, n // 50)):
                y, both = np.sort(rng.permutation(x)[gone:]), n - gone
                more = (100 * both - threshold * n) // threshold
                y = np.unique(np.concatenate([y, rng.integers(0, 2**63, more).astype(np.uint64)]))
                assert 100 * jaccard.common(x, y) >= threshold * len(np.union1d(x, y))
                assert np.intersect1d(jaccard.signatures(x, threshold), jaccard.signatures(y, threshold)).size


def test_jaccard_of_a_large_group_of_near_copies(spark):
    """Variants of one text, some within reach of each other and of others, against brute force."""
    rng = np.random.default_rng(7)
    base, rows = [f"b{k}" for k in range(100)], []
    for i in range(400):
        ws = list(base)
        for at in rng.choice(100, int(rng.integers(0, 9)), replace=False):
            ws[at] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(ws[: int(rng.integers(90, 101))])))
    for width, threshold in ((3, 90), (5, 80)):
        assert {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold, width).collect()} == brute(rows, threshold, width)


def brute(rows, threshold, width):
    """Component ids by comparing all pairs of rows (doc_id, text); the rows' ids are distinct."""
    sets = {}
    for i, t in rows:
        ws = [w.lower() for w in words(t)]
        sets[i] = {tuple(ws[k : k + min(width, len(ws))]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_of_repeated_null_and_large_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    big = 2**60 + 1
    rows = [(7, a), (7, b), (9, b + " end"), (None, a), (None, "only here once"), (big, b), (None, None), (big + 1, "")]
    want = Counter([(7, 7)] * 2 + [(9, 7), (None, 7), (None, None), (big, 7), (None, None), (big + 1, big + 1)])
    for order in (rows, rows[::-1]):
        got = jaccard.join(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want


# 4


def test_bpe_like_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    docs = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode(docs, path, P.PATTERN).collect():
        want = own.encode_ordinary(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# 5


def test_license_scan(spark):
    from terravox.llm.license_texts import LICENSES

    mit = LICENSES["MIT"][1]
    texts = [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 Someone\nCopyright 2021 Another\n\n{mit}"), ("MIT", mit.upper().replace('"', "“").replace(",", " ,")), ("ISC", LICENSES["ISC"][1]), (None, mit + " more"), (None, ""), (None, None)]
    zlib_text = LICENSES["Zlib"][1].replace("acknowledgment", "acknowledgement")
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate([*texts, ("Zlib", zlib_text)])], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert got == {k: v for k, (v, _) in enumerate([*texts, ("Zlib", zlib_text)])}


def test_license_scan_of_whole_and_wrapped_texts(spark):
    import textwrap
    from terravox.llm.license_texts import LICENSES

    whole = {f.stem: f.read_text() for f in licenses.FILES.glob("*.txt")}
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "GFDL-1.3", "CC0-1.0"} <= set(whole)
    known = [*whole.items(), *((k, t) for k, (_, t) in LICENSES.items())]
    one = lambda t: " ".join(t.split())
    texts = [(k, v) for k, t in known for v in (t, one(t), textwrap.fill(one(t), 50), textwrap.fill(one(t), 97))]
    texts += [(k, f"Copyright (c) 2020 X {one(LICENSES[k][1])}") for k in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense")]
    texts += [("ISC", "ISC License\n\nCopyright 2019-2021, A Name\n\n" + textwrap.fill(one(LICENSES["ISC"][1]), 61)), ("BSD-3-Clause", "© 2018 Some Group. All rights reserved.\n\n" + textwrap.fill(one(LICENSES["BSD-3-Clause"][1]), 70))]
    texts += [(None, whole["GPL-3.0"] + " more"), (None, "Copyright (c) 2020 X")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert [(v, got[k], t[:80]) for k, (v, t) in enumerate(texts) if got[k] != v] == []


# 6


def test_webp_transforms_round_trip():
    rng = np.random.default_rng(6)
    for width, height in ((1, 1), (7, 5), (33, 17), (64, 20)):
        smooth = (np.add.outer(np.arange(height) * 3, np.arange(width) * 2) % 256).astype(np.uint32)
        argb = (rng.integers(200, 256, (height, width)).astype(np.uint32) << np.uint32(24) | smooth << np.uint32(16) | (smooth * 2 % 256) << np.uint32(8) | rng.integers(0, 9, (height, width)).astype(np.uint32)).ravel()
        for kind in ("none", "predictor", "cross", "green", "palette"):
            px, out, stored_width = argb, webp.Out(), width
            across, down = (width + 3) // 4, (height + 3) // 4
            tiles = None
            if kind == "predictor":
                modes = rng.integers(0, 14, across * down).astype(np.uint32)
                tiles, body = modes << np.uint32(8) | np.uint32(webp.OPAQUE), predicted(argb, width, webp.modes_at(modes, width, height, 2))
                out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(0, 3)
            elif kind == "cross":
                tiles = rng.integers(0, 2**24, across * down).astype(np.uint32) | np.uint32(webp.OPAQUE)
                body = webp.cross_colour(argb, webp.modes_at(tiles, width, height, 2), undo=False)
                out.put(1, 1), out.put(webp.CROSS_COLOUR, 2), out.put(0, 3)
            elif kind == "green":
                body = webp.green_shift(argb, -1)
                out.put(1, 1), out.put(webp.SUBTRACT_GREEN, 2)
            elif kind == "palette":
                colours = np.unique(argb)[:13]
                px = colours[rng.integers(0, len(colours), width * height)]
                bits = webp.bundle_bits(len(colours))
                index = np.searchsorted(colours, px).reshape(height, width)
                stored_width = (width + (1 << bits) - 1) >> bits
                packed = np.zeros((height, stored_width), np.uint32)
                for x in range(width):
                    packed[:, x >> bits] |= (index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))).astype(np.uint32)
                body = (packed << np.uint32(8) | np.uint32(webp.OPAQUE)).ravel()
                deltas = webp.argb_of(np.diff(webp.channels(colours), axis=0, prepend=np.zeros((1, 4), np.int32)))
                out.put(1, 1), out.put(webp.PALETTE, 2), out.put(len(colours) - 1, 8)
                tiles = deltas
            else:
                body = argb
            if tiles is not None:
                (raw, n), = webp.encode(tiles, np.zeros(len(tiles), np.int64), len(tiles) if kind == "palette" else across, 0, main=False)
                out.put(int.from_bytes(raw, "little") & ((1 << n) - 1), n)
            (raw, _), = webp.encode(body, np.zeros(len(body), np.int64), stored_width, 4, transforms=out)
            ((w, h, got),) = webp.decode(webp.images_of(webp.container(width, height, raw)))
            assert (w, h) == (width, height) and (got == px).all(), (kind, width, height)


def predicted(argb, width, modes):
    """Residuals, pixel by pixel."""
    c, out = webp.channels(argb), []
    for k in range(len(c)):
        y, x = divmod(k, width)
        if k == 0:
            p = np.array([255, 0, 0, 0])
        elif y == 0:
            p = c[k - 1]
        elif x == 0:
            p = c[k - width]
        else:
            p = webp.predict(int(modes[k]), c[k - 1], c[k - width], c[k - width + 1], c[k - width - 1])
        out.append(c[k] - p)
    return webp.argb_of(np.array(out))


def test_webp_far_references_and_tiles_of_codes():
    """A stream with far back-references is put together by hand."""
    out = webp.Out()
    out.put(0, 1), out.put(0, 1), out.put(0, 1)  # no transform, no cache, one group
    green = np.zeros(280, np.int64)
    green[[10, 20, 258, 30]] = 2
    for lengths in (green, *(np.eye(1, 256, k, dtype=np.int64)[0] for k in (1, 2, 255))):
        webp.write_code(out, lengths)
    far = np.zeros(40, np.int64)
    far[[13, 1]] = 1
    webp.write_code(out, far)
    word = webp.code_words(green)
    for g in (10, 20, 30):
        out.put(word[g], 2)
    out.put(word[258], 2)  # length 3
    out.put(webp.code_words(far)[13], 1)
    out.put(122 - 97 - 1 + 1 - 1 + 0, 5)  # symbol 13: 97 + extra; here 121, a distance of 1 beyond the 120 near ones
    out.put(word[10], 2), out.put(word[20], 2)
    ((_, _, got),) = webp.decode(webp.images_of(webp.container(8, 1, out.bytes())))
    assert (got >> np.uint32(8) & np.uint32(255)).tolist() == [10, 20, 30, 30, 30, 30, 10, 20]


def test_media_columns_against_the_texts(spark, sf):
    docs = odd(spark).select("doc_id", "text").unionByName(common.documents(spark, sf).select("doc_id", "text"))
    media = webp.store(docs)
    stored = Counter((r.doc_id, hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in media.collect())
    got = webp.read(media).collect()
    assert Counter((r.doc_id, r.media_sha256, r.media_bytes) for r in got) == stored

    def columns(doc_id, text):
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        return doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])

    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter(columns(r.doc_id, r.text) for r in docs.collect())
    by_payload = {}
    for r in got:
        assert by_payload.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_media_hold_every_transform_and_one_image_a_text():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshr"), 5)) for _ in range(900)]
    prose = " ".join(rng.choice(words, 22000))
    ramp = bytes(np.clip(80 + rng.integers(-1, 2, (80, 192)).cumsum(0), 33, 126).astype(np.uint8)).decode()  # rows much like those above
    texts = [None, "", "a", "ab" * 300, "one line\n" * 900, prose[:600], prose[:12289], prose, ramp, "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 2000, 9000))]
    payloads = [webp.payload(t)[0] for t in texts]
    media = webp.pack_payloads(payloads)
    assert webp.unpack_payloads(media) == payloads
    parts = [webp.parts_of(m) for m in media]
    assert [len(p) for p in parts] == [1] * len(texts) and max(len(e) for ((_, e),) in parts) > 9
    # A reader that knows no segments sees the same image.
    plain = webp.decode([b for ((b, _),) in parts])
    assert [p.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes() for *_, p in plain] == payloads
    heads = webp.read_heads([b for ((b, _),) in parts])
    kinds = [tuple(t[0] for t in h.transforms) for h in heads]
    spatial = (webp.SUBTRACT_GREEN, webp.PREDICTOR, webp.CROSS_COLOUR)
    assert kinds == [(webp.PALETTE,)] * 6 + [spatial] * 4
    modes = {int(m) >> 8 & 15 for h in heads[6:] for m in h.transforms[1][3]}
    factors = {int(f) & 0xFFFFFF for h in heads[6:] for f in h.transforms[2][3]}
    assert len(modes) > 2 and len(factors) > 2
    with pytest.raises(ValueError):  # a segment that begins elsewhere
        webp.decode([parts[7][0][0]], [(parts[7][0][1][0] + 1, *parts[7][0][1][1:])])


def test_webp_tall_images_have_fewer_tiles():
    rows = np.random.default_rng(9).integers(97, 123, 1100 * 192).astype(np.uint8).tobytes()
    (file,) = webp.pack_payloads([rows])
    (head,) = webp.read_heads(webp.images_of(file))
    assert [len(t[3]) for t in head.transforms[1:]] == [4 * 69] * 2 and webp.unpack_payloads([file]) == [rows]


# 7


def test_sharding(spark, sf, tmp_path):
    path = str(tmp_path / "maps")
    sharding.save_map(spark, sharding.first_map(24), path)
    docs = common.documents(spark, sf)
    placed, slots = sharding.shard(docs, path=path)
    rows = placed.collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.elements())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    loads = []
    for s in range(24):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads.append(sum(r["size"] for r in own))
    # No shard is farther from another than the lightest slot that could move between them.
    weight = Counter()
    for r in rows:
        weight[r.virtual_slot] += r["size"]
    heaviest = loads.index(max(loads))
    assert max(loads) - min(loads) <= min(w for v, w in weight.items() if slots.shard_of[v] == heaviest)
    assert all(slots.shard_of[r.virtual_slot] == r.shard for r in rows)
    # Versions stay readable; a second table of more shards edits the newest one.
    assert sharding.load_map(spark, path, 1) == sharding.first_map(24) and sharding.load_map(spark, path) == slots and slots.version == 2
    _, grown = sharding.shard(docs, shards=25, path=path)
    moved = [(a, b) for a, b in zip(slots.shard_of, grown.shard_of, strict=True) if a != b]
    assert grown.version == 3 and sharding.load_map(spark, path) == grown and any(b == 24 for _, b in moved)


# 8


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(40):
        ws = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(0, 150))]
        if k % 3 == 0:
            at = int(rng.integers(0, len(ws) + 1))
            ws[at:at] = passage[: int(rng.integers(20, 60))]
        texts.append(" ".join(ws))
    texts += [texts[3], "x " * 80, None, ""]
    docs = [(k, t) for k, t in enumerate(texts)]
    split = {k: words(t) for k, t in docs}
    seen = Counter(tuple(ws[j : j + 35]) for ws in split.values() for j in range(len(ws) - 34))
    got = {r.doc_id: r for r in doubling.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, ws in split.items():
        gone = {j + m for j in range(len(ws) - 34) if seen[tuple(ws[j : j + 35])] > 1 for m in range(35)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept) == (len(ws), len(gone), kept)


def test_substring_dedup_of_a_joined_table_without_reused_exchanges(spark):
    """All levels see one dealing of the texts, however the input was planned."""
    rng = np.random.default_rng(12)
    body = [f"w{k}" for k in range(90)]
    texts = [" ".join([*(f"a{k}x{j}" for j in range(int(rng.integers(5, 30)))), *body[int(rng.integers(0, 40)) :]]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    joined = docs.join(spark.range(60).withColumnRenamed("id", "doc_id"), "doc_id")
    want = {r.doc_id: (r.n_removed, r.kept) for r in doubling.dedup(docs).collect()}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert {r.doc_id: (r.n_removed, r.kept) for r in doubling.dedup(joined).collect()} == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sum(n > 0 for n, _ in want.values()) > 30


# 9


def test_quality_base_figures(spark, labels):
    got = {(r.doc_id, r.text): r for r in quality.judge(odd(spark), labels).collect()}
    for (_, text), r in got.items():
        ws = words(text)
        windows = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        repeated = {k + m for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for m in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(repeated), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.base_failed == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws))
        assert not (r.base_failed and r.kept)


def test_quality_verdict_against_brute_force(spark, sf):
    """The log-likelihood ratio and the verdict in plain Python; only the hash of an n-gram is taken from Spark."""
    buckets, threshold = 512, -0.02
    docs = common.documents(spark, sf).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    texts = [(r.doc_id, words(r.text), r.text) for r in docs.collect()]
    grams = lambda ws: list(zip(ws, [*ws[1:], None], strict=False))
    known = sorted({g for _, ws, _ in texts for g in grams(ws)}, key=repr)
    hashed = spark.createDataFrame(known, "a string, b string").select("a", "b", *quality.buckets_of(F.struct("a", "b"), buckets)).collect()
    bucket = {(r[0], r[1]): (r[2], r[3]) for r in hashed}
    good_ids = {r.doc_id for r in marks.where("quality = 1 and doc_id is not null").collect()}
    raw, good = Counter(), Counter()
    for i, ws, _ in texts:
        for g in grams(ws):
            raw.update(bucket[g])
            if i in good_ids:
                good.update(bucket[g])
    n, t = sum(raw.values()), sum(good.values())
    share = lambda b: (raw[b] + 1) / (n + buckets)
    ratio = lambda b: math.log((good[b] + buckets * share(b)) / (t + buckets)) - math.log(share(b))
    want = {(i, x): sum(ratio(b) for g in grams(ws) for b in bucket[g]) / (2 * len(ws)) if ws else 0.0 for i, ws, x in texts}
    got = quality.judge(docs, marks, buckets, threshold).collect()
    assert len(got) == len(texts) and 0 < len(good_ids)
    for r in got:
        assert abs(r.llr - want[r.doc_id, r.text]) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= threshold)
    assert {r.kept for r in got if not r.base_failed} == {True, False}


# 10


def test_packing_holds_each_id_once(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in common.documents(spark, sf).collect()}
    pieces = packing.pack(common.documents(spark, sf), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))
    for i, text in docs.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.length for r in parts] == packing.lengths(len(ids))
        assert all(r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    own, end = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [f"end {end} more", end, f"a{end}{end} b", f" {end}\n\n x  {end}  ", f"<|endoftext|{end}|>", "<|ENDOFTEXT|> <|endoftext |>", f"漢{end}😀's {end}'s"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    for i, text in enumerate(texts):
        got = [t for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start) for t in r.ids]
        assert got == [*own.encode(text, add_special_tokens=False).ids, 0]


# Pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    docs = common.documents(spark, sf)
    kept = c.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    near = c.near_duplicates(spark, docs, sf)
    groups = jaccard.join(docs, c.THRESHOLD, c.SHINGLE)
    assert near.columns == docs.columns and near.count() == groups.select("component_id").distinct().count()
    cut = c.substring_dedup(spark, near, sf)
    assert cut.columns == docs.columns and cut.count() == near.count() and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    assert c.run(spark, sf).count() > 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf):
    import corpus_pipeline as c

    for name, stage in c.STAGES[:-1]:
        got = stage(spark, odd(spark), sf)
        assert got.columns == odd(spark).columns and stage(spark, empty(spark), sf).count() == 0
        rows = got.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in odd(spark).collect()} and all((r.score, r.kept, r.block, r.words) == (0.5, "k", "b", 1) for r in rows)
        assert name != "toxicity" or len(rows) == odd(spark).count()
    assert {r.doc_id for r in c.pack(spark, odd(spark), sf).collect()} == {r.doc_id for r in odd(spark).collect()}
    assert c.pack(spark, empty(spark), sf).count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark, sf):
    import corpus_pipeline as c

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"r{k}" for k in rng.integers(0, 10**9, n))
    a, b, d, e, f = (text(60) for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, d), (None, d), (5, e), (5, e.upper()), (9, e + " end"), (6, f), (6, text(60)), (7, text(60)), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = common.materialize(c.near_duplicates(spark, docs, sf), "near")
    assert near.columns == docs.columns
    assert Counter(r.doc_id for r in near.collect()) == Counter([1, 2, None, 5, 6, 6, 7, 3, None])
    assert {(r.text or "").lower() for r in near.collect()} == {(t or "").lower() for _, t in rows if t != e + " end"}
    cut = {(r.doc_id, (r.text or "").lower()) for r in c.substring_dedup(spark, near, sf).collect()}
    assert {(1, a), (2, b), (None, d), (5, e)} <= cut
    packed = c.pack(spark, c.substring_dedup(spark, near, sf), sf).collect()
    assert min(sum(r.length for r in packed if r.doc_id == i) for i in (1, 2, 5)) > 60


def test_short_words_keep_their_spelling(spark):
    """Spellings are equal after three letters only: texts that differ by "four" and "for" have two digests."""
    form = lambda *texts: [r.c for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(licenses.canonical(F.col("t")).alias("c")).collect()]
    apart = form("for hour rise hence", "four hor rize hense")
    assert apart[0] != apart[1] and apart == ["for hour rise hence", "four hor rize hense"]
    same = form("Colour, licence; organisations favoured", "color license ORGANIZATIONS favored.")
    assert same[0] == same[1]
