"""Operator 3: n-gram Jaccard join by PartEnum signatures.

Sets are distinct word shingles, hashed to 56 bits. Sizes fall into bands [l, l / threshold]; two sets that reach the
threshold lie in one band or in two next to each other, and within those the symmetric difference is at most some k.
For that k the feature domain is cut into n1 parts and each of these into n2 (by a hash); as at most k features differ,
some part has at most k2 differing ones, so that the two sets agree on n2 - k2 of its subparts. A signature is the hash
of the features in one such choice of subparts; sets that are similar enough share one. Each set is signed for its own
band and for the next.

Before that, sets that cannot have a partner are told apart: a feature that no other set has cannot be common, so a set
of which more than 1 - threshold is of that kind is linked with nothing. Documents are dealt into blocks; a block sends
each distinct feature once to the bucket of its hash, and the bucket answers in how many blocks it occurs. The answer
also orders features from rare to frequent, alike for all sets.

Texts with equal sets are one node. Sets that share a signature are candidates. A group of them is not expanded into
pairs: the set with the fewest features of its own is the group's pivot, and each set is compared with the pivot that it
shares the most signatures with. Verified links are contracted into components. What is left are links between sets of
different components: sets that share a signature with any other are looked up by their rarest features, as many as
two sets of those sizes cannot all do without (similar sets share one of them, in places that leave enough features to
follow). Of a feature's sets those of its most frequent component are met by the others only, so that a large group of
near copies, already one component, makes no pairs within itself. Each such pair is verified as well, and the links join
their components. No link between different components is missed; nothing repeats in rounds that grow with a group.

Null, empty and wordless texts have the empty set, linked with nothing; fewer words than a shingle make one shingle.
Repeated ids: each row is a text of its own; component_id is the least id among the texts of its component. A null id
is never the least unless there is no other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, by_range, discard, distinct, documents, materialize, mixed, pack, unpack, word_hashes
from .components import components

SHINGLE = 3
#: Similarity in hundredths.
THRESHOLD = 90
#: Bytes of text that a block is made for, and the least number of blocks.
BLOCK_BYTES = 12 << 20
LEAST_BLOCKS = 96
#: Features that a bucket is made for; a text has one for about every 5 bytes.
BUCKET_FEATURES = 2_000_000
#: A part with fewer features than this says little.
THIN = 2
#: The bits of a 64-bit hash that a feature keeps.
KEPT = ~np.uint64(255)


def shingles(texts: list[bytes], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: 56 bits, then eight zeros."""
    h, sizes = word_hashes(texts, lower=True)
    factor = [np.uint64(int(MIX) ** (k + 1) % 2**64) for k in range(width)]
    whole = np.zeros(0, np.uint64)
    if len(h) >= width:
        whole = sum(h[k : len(h) - width + 1 + k] * factor[k] for k in range(width))
        whole = mixed(whole + np.uint64(width)) & KEPT
    start = 0
    for n in sizes.tolist():
        if n >= width:
            yield distinct(whole[start : start + n - width + 1])
        else:
            yield mixed(sum((h[start + k : start + k + 1] * factor[k] for k in range(n)), np.zeros(1, np.uint64)) + np.uint64(n)) & KEPT if n else np.zeros(0, np.uint64)
        start += n


@lru_cache(maxsize=None)
def bands(threshold: int, above: int) -> tuple[tuple[int, int], ...]:
    """Size bands (least, most) from 1 until one reaches `above`."""
    out = [(1, 100 // threshold)]
    while out[-1][1] < above:
        least = out[-1][1] + 1
        out.append((least, least * 100 // threshold))
    return tuple(out)


@lru_cache(maxsize=None)
def plan(threshold: int, band: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, k) for sets of this band and the one before: n1 parts, n2 subparts each, of which all but k2 are chosen.

    Small differences k are enumerated (one part or a few, k2 = 1: two of three subparts); beyond, parts without
    differing features are the cheaper choice: more than k of them, by as many as are likely to be thin, so that thin
    ones, on which sets without any likeness agree by chance, need no signature.
    """
    least, most = bands_to(threshold, band)[max(0, band - 1)][0], bands_to(threshold, band)[band][1]
    k = 2 * most * (100 - threshold) // (100 + threshold)
    if k == 0:
        return 1, 1, 0, k
    if k <= 12:
        return (k + 2) // 2, 3, 1, k
    held = least / (k + 1)
    return k + 3 + math.ceil(1.5 * (k + 1) * math.exp(-held) * (1 + held)), 1, 0, k


@lru_cache(maxsize=None)
def bands_to(threshold: int, band: int) -> tuple[tuple[int, int], ...]:
    above = 1
    while len(bands(threshold, above)) <= band:
        above *= 2
    return bands(threshold, above)


def band_of(threshold: int, size: int) -> int:
    return next(i for i, (_, most) in enumerate(bands(threshold, 1 << size.bit_length())) if size <= most)


def signatures(features: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """64-bit signatures of a set for its band and the next."""
    own = band_of(threshold, len(features))
    out = []
    for band in (own, own + 1):
        n1, n2, k2, k = plan(threshold, band)
        cell = (mixed(features + MIX) % np.uint64(n1 * n2)).astype(np.int64)
        # The sum of mixed features is a hash of the set in a cell, whatever their order.
        order = np.argsort(cell, kind="stable")
        filled, first = np.unique(cell[order], return_index=True)
        sums = np.zeros(n1 * n2, np.uint64)
        sums[filled] = np.add.reduceat(mixed(features ^ MIX)[order], first)
        sums = mixed(sums + np.uint64(band)).reshape(n1, n2)
        for chosen in itertools.combinations(range(n2), n2 - k2):
            salt = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(sum(1 << c for c in chosen))
            sig = mixed(salt * MIX + np.uint64(band))
            for c in chosen:
                sig = mixed(sig * MIX + sums[:, c])
            if n2 == 1:
                # n1 - k parts or more agree with any similar set: if fewer are thin, one of those is not, there as here.
                thin = np.bincount(cell, minlength=n1) < THIN
                sig = sig[~thin] if np.count_nonzero(thin) < n1 - k else sig
            out.append(sig)
    return np.unique(np.concatenate(out)).view(np.int64)


SETS = "block int, digest binary, n_shingles long, doc_ids array<bigint>, features binary"


def coded(features: np.ndarray) -> bytes:
    """A sorted set as differences, in planes of bytes."""
    return pack(np.diff(features >> np.uint64(8), prepend=np.uint64(0)))


def decoded(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) << np.uint64(8)


def _sets(width: int, blocks: int):
    """Rows of SETS for the distinct sets of a batch; the ids of its copies are listed, so that a batch sends a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        salt = (task.partitionId() if task else 0).to_bytes(4, "little")
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            for lo in range(0, len(ids), 1000):
                found: dict[bytes, list] = {}
                for doc_id, s in zip(ids[lo : lo + 1000], shingles([t or b"" for t in text.slice(lo, 1000).to_pylist()], width), strict=True):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest not in found:
                        found[digest] = [len(s), [], coded(s)]
                    found[digest][1].append(doc_id)
                block = [int.from_bytes(hashlib.blake2b(d + salt, digest_size=8).digest(), "little") % blocks for d in found]
                columns = [pa.array(block, pa.int32()), pa.array(list(found), pa.binary())]
                columns += [pa.array(c, t) for c, t in zip(zip(*found.values(), strict=True), (pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
                yield pa.record_batch(columns, names=["block", "digest", "n_shingles", "doc_ids", "features"])

    return run


def _features(sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a block's distinct sets end to end, how many each set has, and to which of them each row belongs."""
    place: dict[bytes, int] = {}
    row = np.array([place.setdefault(d, len(place)) for d in sets.column("digest").to_pylist()], np.int64)
    first = np.unique(row, return_index=True)[1]
    data = [decoded(d) for d in sets.column("features").take(pa.array(first)).to_pylist()]
    return np.concatenate(data), np.array([len(d) for d in data], np.int64), row


def _ask(buckets: int):
    shift = np.uint64(max(0, 33 - buckets.bit_length()))

    def run(sets: pa.Table) -> pa.Table:
        """A block's distinct features, sorted into buckets, by 32 bits of what sets them apart there."""
        key = distinct(_features(sets)[0])
        parts = by_range(key, buckets)
        keys = [pack(np.diff(key[at] % np.uint64(2**64 // buckets + 1) >> shift, prepend=np.uint64(0))) for _, at in parts]
        block = sets.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int32()), "keys": pa.array(keys, pa.binary())})

    return run


#: Code of a number of blocks: 1 + CODE_STEPS times its logarithm to base 2. Code 0 marks a feature of one set alone.
CODE_STEPS = 7


def _reply(asked: pa.Table) -> pa.Table:
    """For each block that asked this bucket: the codes of how many blocks have its keys."""
    parts = [np.cumsum(unpack(k), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    code = (1 + np.floor(CODE_STEPS * np.log2(count))).astype(np.uint8)[back]
    codes, at = [], 0
    for part in parts:
        codes.append(code[at : at + len(part)].tobytes())
        at += len(part)
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "codes": pa.array(codes, pa.binary())})


JUDGED = "digest binary, n_shingles long, doc_ids array<bigint>, alone int, features binary, codes binary"


def _judge(buckets: int, threshold: int):
    def run(sets: pa.Table, replies: pa.Table) -> pa.Table:
        """The block's sets: features and codes of those that may have a partner, nulls for the others."""
        features, sizes, row = _features(sets)
        n = np.array(sets.column("n_shingles").to_pylist(), np.int64)
        alone, rows, codes, may = np.zeros(len(sizes), np.int64), [None] * len(sizes), [None] * len(sizes), np.zeros(len(sizes), bool)
        if len(features):
            key, back, count = np.unique(features, return_inverse=True, return_counts=True)
            answers = dict(zip(replies.column("bucket").to_pylist(), replies.column("codes").to_pylist(), strict=True))
            code = np.zeros(len(key), np.uint8)
            for b, at in by_range(key, buckets):
                code[at] = np.frombuffer(answers[b], np.uint8)
            code[(code == 1) & (count == 1)] = 0
            code, starts = code[back], np.cumsum(sizes) - sizes
            alone = np.bincount(np.repeat(np.arange(len(sizes)), sizes), code == 0, len(sizes)).astype(np.int64)
            may = (sizes > 0) & (100 * alone <= (100 - threshold) * sizes)
            for k in np.flatnonzero(may).tolist():
                at = slice(starts[k], starts[k] + sizes[k])
                rows[k], codes[k] = features[at].tobytes(), code[at].tobytes()
        of = lambda values, kind: pa.array([values[k] for k in row.tolist()], kind)
        return pa.table({"digest": sets.column("digest"), "n_shingles": pa.array(n), "doc_ids": sets.column("doc_ids"), "alone": of(alone, pa.int32()), "features": of(rows, pa.binary()), "codes": of(codes, pa.binary())})

    return run


def judged(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """Rows of JUDGED; features is null for sets that are linked with nothing but copies of themselves."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)), max(64, -(-size // (5 * BUCKET_FEATURES)))
    grouped = docs.mapInArrow(_sets(width, blocks), SETS).groupBy("block")
    asked = grouped.applyInArrow(_ask(buckets), "bucket int, block int, keys binary")
    replies = asked.groupBy("bucket").applyInArrow(_reply, "block int, bucket int, codes binary")
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(_judge(buckets, threshold), JUDGED)


def sign(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (sig, node, size, alone), one for each signature of a set of (node, n_shingles, alone, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sigs = [signatures(np.frombuffer(f, np.uint64), threshold) for f in part.column("features").to_pylist()]
                times = [len(s) for s in sigs]
                same = [np.repeat(part.column(c).to_numpy(), times) for c in ("node", "n_shingles", "alone")]
                yield pa.record_batch([pa.array(np.concatenate(sigs)), *map(pa.array, same)], names=["sig", "node", "size", "alone"])

    return nodes.select("node", "n_shingles", "alone", "features").mapInArrow(run, "sig long, node long, size long, alone int")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verify(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common(x, y)
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (nodes.select(F.col("node").alias(k), F.col("features").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rare(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (feature, node, size, root, place): a set's rarest features, as many as its smallest partner may do without and one.

    Features of one set alone count as places but make no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, times = [], []
            for f, c in zip(batch.column("features").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                f, c = np.frombuffer(f, np.uint64), np.frombuffer(c, np.uint8)
                order = np.lexsort((f, c))[: len(f) + threshold * len(f) // -100 + 1]
                place = np.flatnonzero(c[order] > 0)
                out.append((f[order[place]].view(np.int64), place))
                times.append(len(place))
            same = [np.repeat(batch.column(k).to_numpy(), times) for k in ("node", "n_shingles", "root")]
            feature, place = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(feature), *map(pa.array, same), pa.array(place)], names=["feature", "node", "size", "root", "place"])

    return nodes.select("node", "n_shingles", "root", "features", "codes").mapInArrow(run, "feature long, node long, size long, root long, place long")


def _left_over(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a rare feature, with enough features of both to follow it."""
    by_root = rows.groupBy("feature", "root").agg(F.count(F.lit(1)).alias("n"))
    most = by_root.groupBy("feature").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    others = rows.join(most.select("feature", "most"), "feature").where("root <> most").select("feature", *(F.col(c).alias(f"o_{c}") for c in ("node", "size", "root", "place")))
    needed = F.ceil(threshold * (F.col("size") + F.col("o_size")) / (100 + threshold))
    meets = (F.col("root") != F.col("o_root")) & (F.col("place") <= F.col("size") - needed) & (F.col("o_place") <= F.col("o_size") - needed)
    return others.join(rows, "feature").where(meets).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def join(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sets = materialize(judged(docs, threshold, width), "sets")
    # One node for equal sets, numbered once they are written.
    leaders = sets.where("features is not null").groupBy("digest").agg(F.first(F.struct("n_shingles", "alone", "features", "codes")).alias("s"))
    nodes = materialize(leaders.select(F.monotonically_increasing_id().alias("node"), "digest", "s.*"), "nodes")
    signed = materialize(sign(nodes, threshold), "signed")
    # Only signatures that several nodes share go further. A group's pivot is its node with the fewest features of its own.
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("alone", F.xxhash64("node").alias("h"), "node", "size")).alias("p")).where("n > 1")
    members = signed.join(groups.select("sig", F.col("p.node").alias("p"), F.col("p.size").alias("p_size")), "sig")
    votes = materialize(members.groupBy("node", "size", "p", "p_size").agg(F.count(F.lit(1)).alias("votes")), "votes")
    discard(signed)
    alike = 100 * F.least("size", "p_size") >= threshold * F.greatest("size", "p_size")
    met = votes.where("node <> p").where(alike).groupBy("node").agg(F.max_by("p", F.struct("votes", "p")).alias("p"))
    links = materialize(_verify(met.select(F.col("p").alias("a"), F.col("node").alias("b")), nodes, threshold), "links")
    roots = components(links)
    candidates = votes.select("node").distinct().join(roots, F.col("node") == roots["id"], "left").select("node", F.coalesce("root", "node").alias("root"))
    rows = materialize(rare(nodes.join(candidates, "node"), threshold), "rare")
    found = materialize(_verify(_left_over(rows, threshold), nodes, threshold), "found")
    discard(votes, rows, links)
    if not found.isEmpty():
        first, roots = roots, components(found.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b")))
        discard(first)
    discard(found)
    # The least id of each set, then of each component.
    own = sets.where("n_shingles > 0").groupBy("digest").agg(F.min(F.array_min("doc_ids")).alias("own"))
    placed = own.join(nodes.select("digest", "node"), "digest", "left").join(roots, F.col("node") == roots["id"], "left").select("digest", "own", "root")
    least = placed.where("root is not null").groupBy("root").agg(F.min("own").alias("least"))
    classes = placed.join(least, "root", "left").select("digest", F.coalesce("least", "own").alias("component_id"))
    rows = sets.select("digest", "n_shingles", F.explode("doc_ids").alias("doc_id")).join(classes, "digest", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
