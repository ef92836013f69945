"""Operator 1: language-model scores by a hierarchical Pitman-Yor model.

Every word (and the start of a text) is a context with a restaurant of its own, whose customers are the words that
follow it; all of these share one parent, the restaurant of single words, over a uniform base. Each table of a context
is one customer of the parent. Chinese-restaurant seating is sampled by Gibbs sweeps over table counts. A sweep goes
through three draws, each given the newest of the others: for each restaurant y from Gamma(strength / d + tables), which
makes its dishes independent; for the parent the probabilities of its words from the gamma variates of its seating; then,
for each dish, the tables t of its c customers, with weight S_d(c, t) a^t (generalised Stirling numbers), where
a = d y p is the weight of opening one and p the parent's probability; after the contexts, the parent is seated in the
same way. So all dishes of a level are drawn side by side, as a cluster wants it, and still from their conditionals.
Beyond EXACT customers of a dish those weights have come close to their limit for many customers, t - 1 from Poisson(a /
d), which is drawn with its first correction (tests measure it against the exact weights of 2000 customers).  Draws come from hashes of dish, context and sweep, so any task that knows a dish's counts gets
the same seating. After BURN_IN sweeps, a text's score is the sum of log10 of its tokens' predictive probabilities
averaged over the sweeps that follow. Discounts are estimated from the counts of counts, n1 / (n1 + 2 n2).

Documents are dealt into blocks by a hash. A block sends the distinct words and word pairs of its texts, with their
training counts, sorted into buckets; buckets add up and answer, and one of the blocks that hold a pair is told to count
its tables. After each sweep blocks send tables by word, buckets add up, seat the parent's customers and answer. What
all blocks need to know of the whole (tokens, types, tables) is a row of sums. Words that a third of the corpus uses
cost one entry a block. Pairs are sent as 40 bits within their bucket; a bucket is made for a constant number of pairs,
so that the odds of taking two pairs for one stay at some 4 in a million at any size.

Null and empty texts are one end token. Rows with null id count as id "". Repeated rows count as often as they occur.
Without training texts all probabilities are those of the base. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, by_range, documents, fold, mixed, order_of, pack, ranked, unpack, word_hashes

FOLDS, HELD_OUT = 5, 1
#: Sweeps that are averaged, and those before them that are not.
SWEEPS, BURN_IN = 2, 1
#: Strength of the contexts and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Customers up to which table counts are drawn from their exact weights.
EXACT = 1024
BLOCK_BYTES = 12 << 20
LEAST_BLOCKS = 64
#: Pairs that a bucket is made for; a text has about a pair for every 6 bytes.
BUCKET_PAIRS = 4_000_000
WORDS, PAIRS, FIRST_SWEEP = 0, 1, 2
#: Hashes of the end of a text and of what comes before its first word.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0xC2B2AE3D27D4EB4F)

ASK = "block int, kind int, bucket int, keys binary, values binary, more binary, s0 double, s1 double, s2 double"
REPLY = "block int, kind int, bucket int, values binary, s0 double, s1 double, s2 double, s3 double"


def chance(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return ((mixed(key ^ np.uint64(salt * int(MIX) % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def normal(key: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(chance(key, salt))) * np.cos(2 * np.pi * chance(key, salt + 1))


def gamma(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variates of unit scale by squeeze and rejection; shapes below 1 by the power of a uniform number."""
    below = shape < 1
    d = shape + below - 1 / 3
    out, left = d.copy(), np.arange(len(d))
    for k in range(salt, salt + 60, 3):
        x, at = normal(key[left], k), d[left]
        v = np.maximum(1e-200, (1 + x / np.sqrt(9 * at)) ** 3)
        good = (v > 1e-200) & (np.log(chance(key[left], k + 2)) < 0.5 * x * x + at - at * v + at * np.log(v))
        out[left[good]] = (at * v)[good]
        left = left[~good]
        if not len(left):
            break
    if below.any():
        out[below] *= chance(key[below], salt + 60) ** (1 / np.maximum(shape[below], 1e-12))
    return out


@lru_cache(maxsize=8)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S_d(c, t)."""
    log = np.full((most + 1, most + 1), -np.inf)
    log[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            stay = np.where(t <= c, c - d * t, 0.0)
            log[c + 1] = np.logaddexp(np.log(np.maximum(stay, 0)) + log[c], np.concatenate([[-np.inf], log[c, :-1]]))
    return log


def poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Draws by inversion, or from the normal distribution where the mean is large."""
    draw = np.floor(np.maximum(0, mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)) + 0.5)
    small = np.flatnonzero(mean < 30)
    p = np.exp(-mean[small])
    total, count = p.copy(), np.zeros(len(small))
    for k in range(1, 90):
        more = u[small] > total
        if not more.any():
            break
        count += more
        p = p * mean[small] / k
        total += p
    draw[small] = count
    return draw


def seat(c: np.ndarray, a: np.ndarray, key: np.ndarray, sweep: int, d: float) -> np.ndarray:
    """Table counts of dishes with c customers each, drawn anew."""
    t = np.minimum(c, 1).astype(np.float64)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    exact = np.flatnonzero(c[many] <= EXACT)
    log, first = stirling(d), c[many].astype(np.int64)
    order = exact[np.argsort(first[exact], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(first[order], prepend=-1)), len(order))
    u, log_a = chance(key[many], 2 * sweep), np.log(a[many])
    for lo, hi in zip(cuts, cuts[1:]):
        at = order[lo:hi]
        n = int(first[at[0]])
        weight = log[n, 1 : n + 1] + np.arange(1, n + 1) * log_a[at, None]
        weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
        t[many[at]] = 1 + (weight[:, :-1] < u[at, None] * weight[:, -1:]).sum(1)
    left = many[c[many] > EXACT]
    if len(left):
        closer = 0.5 * abs(math.gamma(-d) / math.gamma(-2 * d)) * c[left] ** -d if abs(2 * d - 1) > 1e-6 else 0.0
        draw = poisson(a[left] / d * np.exp(-closer), chance(key[left], 2 * sweep + 1), chance(key[left], 2 * sweep + 5001))
        t[left] = 1 + np.minimum(draw, c[left] - 1)
    return t


def discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / max(1.0, n1 + 2 * n2)))


class Block:
    """Tokens of a block's documents, in a fixed order, as places in its vocabulary, and its distinct pairs by rising key."""

    def __init__(self, packed: pa.Table) -> None:
        table = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in packed.column("docs").to_pylist()])
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.held = table.column("doc_id"), table.column("held_out").to_numpy()
        hashes, sizes = word_hashes([t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], lower=True)
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = np.zeros(self.sizes.sum(), bool)
        ends[self.starts + sizes] = True
        token = np.full(len(ends), END)
        token[~ends] = hashes
        token = np.append(token, START)
        self.words, place = ranked(token)
        self.token, start = place[:-1], int(place[-1])
        context = np.concatenate([self.token[:1], self.token[:-1]])
        context[self.starts] = start
        train = np.repeat(~self.held, self.sizes)
        self.trained = np.bincount(self.token[train], minlength=len(self.words))
        self.trained[start] = np.count_nonzero(~self.held)
        key = mixed((self.words * MIX)[context] + self.words[self.token])
        self.order = order_of(key)
        key = key[self.order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.key, self.times = key[first], np.diff(np.append(first, len(key)))
        self.context, self.word = context[self.order[first]], self.token[self.order[first]]
        self.pair_trained = np.add.reduceat(train[self.order].astype(np.int64), first)


def _short(key: np.ndarray, buckets: int) -> bytes:
    """Keys of one bucket by 40 bits of what sets them apart there."""
    return pack(key % np.uint64(2**64 // buckets + 1) >> np.uint64(max(0, 24 - buckets.bit_length() + 1)))


class Replay:
    """What a block knows after the answers that it has: counts, the next sweep's seating, or the predictive probabilities of those after the burn-in."""

    def __init__(self, block: Block, replies: list[dict], buckets: int, asking: bool) -> None:
        self.block, self.buckets = block, buckets
        self.answers = {(r["kind"], r["bucket"]): r for r in replies}
        self.kinds = {r["kind"]: r for r in replies}
        self.by_word = by_range(block.words, buckets)
        self.predictive: list[np.ndarray] = []
        if WORDS not in self.kinds:
            return
        self.count = self.gather(WORDS, self.by_word, len(block.words))[0].astype(np.float64)
        both = self.gather(PAIRS, by_range(block.key, buckets), len(block.key))[0]
        self.own, self.pairs = (both & np.uint64(1)).astype(bool), (both >> np.uint64(1)).astype(np.float64)
        w, p = self.kinds[WORDS], self.kinds[PAIRS]
        self.n, self.types = w["s0"], w["s1"]
        self.d0, self.d = discount(w["s2"], w["s3"]), discount(p["s0"], p["s1"])
        self.sweep = FIRST_SWEEP + len(self.kinds) - 2
        if asking:
            self.seated = self.seating(self.sweep, self.own)
            return
        for sweep in range(FIRST_SWEEP + BURN_IN, self.sweep):
            tables, customers, at, all_customers, all_tables = self.after(sweep)
            parent = (np.maximum(customers - self.d0 * at, 0) + (PARENT_STRENGTH + self.d0 * all_tables) / (self.types + 1)) / (PARENT_STRENGTH + all_customers)
            opened = (STRENGTH + self.d * tables[block.context]) * parent[block.word]
            self.predictive.append((np.maximum(self.pairs - self.d * self.seating(sweep), 0) + opened) / (STRENGTH + self.count[block.context]))

    def after(self, sweep: int) -> tuple:
        """Each word's tables as a context, its customers and tables at the parent, and the parent's sums; before the first sweep each customer has a table."""
        if sweep < FIRST_SWEEP:
            return self.count, self.count, np.minimum(self.count, 1), self.n, self.types
        tables, customers, at = (x.astype(np.float64) for x in self.gather(sweep, self.by_word, len(self.block.words), 3))
        return tables, customers, at, self.kinds[sweep]["s0"], self.kinds[sweep]["s1"]

    def seating(self, sweep: int, asked: np.ndarray | None = None) -> np.ndarray:
        """Tables of each pair (of those asked, else 0), drawn given the sweep before."""
        tables, customers, at, all_customers, all_tables = self.after(sweep - 1)
        self.sums = (self.types, all_tables, self.d0)
        block, salt = self.block, 1000 * sweep
        seated = np.minimum(self.pairs, 1) if asked is None else np.minimum(self.pairs, 1) * asked
        drawn = np.flatnonzero((self.pairs > 1) & (seated > 0))  # a single customer has one table
        shape = np.maximum(customers - self.d0 * at, 0) + (PARENT_STRENGTH + self.d0 * all_tables) / (self.types + 1)
        word, of_word = np.unique(block.word[drawn], return_inverse=True)
        context, of_context = np.unique(block.context[drawn], return_inverse=True)
        parent = np.maximum(gamma(shape[word], block.words[word], salt) / (PARENT_STRENGTH + all_customers), 1e-300)
        y = gamma(STRENGTH / self.d + tables[context], block.words[context], salt + 100)
        seated[drawn] = seat(self.pairs[drawn], self.d * y[of_context] * parent[of_word], block.key[drawn], sweep, self.d)
        return seated

    def gather(self, kind: int, places: list[tuple[int, slice]], size: int, columns: int = 1) -> list[np.ndarray]:
        out = [np.zeros(size, np.uint64) for _ in range(columns)]
        for bucket, at in places:
            got = unpack(self.answers[kind, bucket]["values"]).reshape(columns, -1)
            for column, values in zip(out, got, strict=True):
                column[at] = values
        return out


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, docs): a batch's documents of one block as a compressed table, which takes half the room of rows in a shuffle."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        order = np.argsort(batch.column("block").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        block = batch.column("block").to_numpy()
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        blobs = []
        for lo, hi in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            part = batch.slice(lo, hi - lo).select(["doc_id", "text", "held_out"])
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(block[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "docs"])


def _asks(buckets: int):
    def ask(docs: pa.Table, replies: pa.Table | None) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            number, block = docs.column("block")[0].as_py(), Block(docs)
            known = Replay(block, [] if replies is None else replies.to_pylist(), buckets, True)
            if replies is None:
                for b, at in known.by_word:
                    rows.append((number, WORDS, b, pack(block.words[at]), pack(block.trained[at]), b"", 0.0, 0.0, 0.0))
                for b, at in by_range(block.key, buckets):
                    rows.append((number, PAIRS, b, _short(block.key[at], buckets), pack(block.pair_trained[at]), b"", 0.0, 0.0, 0.0))
            else:
                mine = known.seated
                tables, customers = (np.bincount(x, mine, len(block.words)) for x in (block.context, block.word))
                for b, at in known.by_word:
                    rows.append((number, known.sweep, b, _short(block.words[at], buckets), pack(tables[at]), pack(customers[at]), *known.sums))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        types = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.float64()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "kind", "bucket", "keys", "values", "more", "s0", "s1", "s2"])

    def first(docs: pa.Table) -> pa.Table:
        return ask(docs, None)

    def later(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return ask(docs, replies)

    return first, later


def _reply(asked: pa.Table) -> pa.Table:
    """Sums for each key of the bucket, to each block that asked; and a row of block -1 with the bucket's totals."""
    asked = asked.sort_by("block")
    kind, bucket = asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py()
    keys = [unpack(k) for k in asked.column("keys").to_pylist()]
    given = np.concatenate([unpack(v) for v in asked.column("values").to_pylist()])
    key, back = ranked(np.concatenate(keys))
    total = np.bincount(back, given, len(key))
    sums = [0.0] * 4
    if kind == WORDS:
        words = key != START
        sums = [float(total[words].sum()), *(float(np.count_nonzero(x & words)) for x in (total > 0, total == 1, total == 2))]
        columns = [total[back]]
    elif kind == PAIRS:
        sums[:2] = float(np.count_nonzero(total == 1)), float(np.count_nonzero(total == 2))
        giving = np.flatnonzero(given)
        owner = np.zeros(len(back), bool)
        owner[giving[np.unique(back[giving], return_index=True)[1]]] = True
        columns = [2 * total[back] + owner]
    else:
        types, tables, d0 = (asked.column(c)[0].as_py() for c in ("s0", "s1", "s2"))
        customers = np.bincount(back, np.concatenate([unpack(v) for v in asked.column("more").to_pylist()]), len(key))
        y = gamma(np.array([PARENT_STRENGTH / d0 + tables]), np.array([START]), 1000 * kind + 200)[0]
        seated = seat(customers, np.full(len(key), d0 * y / (types + 1)), key, kind, d0)
        sums[:2] = float(customers.sum()), float(seated.sum())
        columns = [total[back], customers[back], seated[back]]
    values, at = [], 0
    for k in keys:
        values.append(pack(np.concatenate([c[at : at + len(k)] for c in columns])))
        at += len(k)
    n = len(keys)
    return pa.table({
        "block": pa.array([*asked.column("block").to_pylist(), -1], pa.int32()), "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "values": pa.array([*values, b""], pa.binary()), **{f"s{j}": pa.array([0.0] * n + [sums[j]], pa.float64()) for j in range(4)},
    })


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _finish(buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs)
        known = Replay(block, replies.to_pylist(), buckets, False)
        base = np.log10((known.count + 0.5) / (known.n + 0.5 * (known.types + 1)))
        mean = np.log10(sum(known.predictive) / len(known.predictive))
        over = lambda values: np.add.reduceat(values, block.starts)
        document = np.repeat(np.arange(len(block.sizes)), block.sizes)
        score = np.bincount(document[block.order], np.repeat(mean, block.times), len(block.sizes))
        return pa.table({
            "doc_id": block.ids, "held_out": pa.array(block.held), "n_tokens": pa.array(block.sizes), "n_known": pa.array(over((known.count[block.token] > 0).astype(np.int64))),
            "train_tokens": pa.array([int(known.n)] * len(block.sizes), pa.int64()), "base_score": pa.array(over(base[block.token])), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(300, -score / block.sizes)),
        })

    return run


def scores(docs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one per row of docs.

    Texts are dealt to their blocks once: the plans of the sweeps share that exchange, and those of questions and answers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)), max(64, -(-size // (6 * BUCKET_PAIRS)))
    grouped = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(_deal, "block int, docs binary").groupBy("block")
    first, later = _asks(buckets)
    replies = None
    for _ in range(BURN_IN + sweeps + 1):
        asked = grouped.applyInArrow(first, ASK) if replies is None else grouped.cogroup(replies.groupBy("block")).applyInArrow(later, ASK)
        reply = asked.groupBy("kind", "bucket").applyInArrow(_reply, REPLY)
        sums = reply.where("block < 0").groupBy("kind").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(4)))
        told = reply.where("block >= 0").select("block", "kind", "bucket", "values").join(F.broadcast(sums), "kind").repartition("block")
        replies = told if replies is None else replies.unionByName(told)
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(_finish(buckets), SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
