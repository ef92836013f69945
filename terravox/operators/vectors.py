"""Descriptor vectors: projections, residual codings, prototypes, votes and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cosine, dot, norm, unit
from ..sources.working import written


def components(rows: DataFrame, key: list[str], v: str = "v") -> DataFrame:
    return rows.select(*key, F.posexplode(v).alias("d", "x"))


#: Groups whose sums a task holds before it passes them on.
HELD = 4096


def group_sums(rows: DataFrame, group: list[str], v: str = "v") -> DataFrame:
    """Rows (group, d, x, n): sum of each component over a group's vectors, and how many have it; entries must not be null.

    A task adds up its own vectors in numpy and gives a row for each group it has met, so a vector is never spread into a row
    a component; null vectors are skipped.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    kinds = [rows.schema[c].dataType.simpleString() for c in group]

    def run(batches):
        held: dict[tuple, list] = {}

        def flush():
            keys = list(zip(*(k[:-1] for k in held), strict=True)) if held else [[]] * len(group)
            out = [pa.array(list(c), kind) for c, kind in zip(keys, arrow, strict=True)]
            out += [pa.array([x for x, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())]
            held.clear()
            return pa.record_batch(out, names=[*group, "x", "n"])

        arrow = None
        for batch in batches:
            arrow = [batch.schema.field(c).type for c in group]
            vectors = batch.column(len(group)).to_pylist()
            df = pd.DataFrame({c: batch.column(c).to_pylist() for c in group} | {"size": [-1 if x is None else len(x) for x in vectors]}, dtype=object)
            kept = df[df["size"] >= 0]
            for key, at in kept.groupby([*group, "size"], dropna=False, sort=False).indices.items():
                x = np.array([vectors[k] for k in kept.index[at]], float)
                key = tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                total = held.setdefault(key, [np.zeros(x.shape[1]), 0])
                total[0], total[1] = total[0] + x.sum(0), total[1] + len(x)
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join(f"`{c}` {k}" for c, k in zip(group, kinds, strict=True)) + ", x array<double>, n long"
    parts = rows.select(*group, v).mapInArrow(run, schema)
    return parts.select(*group, "n", F.posexplode("x").alias("d", "x")).groupBy(*group, "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def class_means(rows: DataFrame, label: str, v: str = "v") -> DataFrame:
    """Rows (label, d, x): mean vector of each label, component by component."""
    return group_sums(rows, [label], v).select(label, "d", (F.col("x") / F.col("n")).alias("x"))


def as_vectors(parts: DataFrame, label: str, name: str = "c") -> DataFrame:
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(name))


def moments(rows: DataFrame, n: int, v: str = "v") -> DataFrame:
    """Rows (a, b, g) with a <= b: sums of v[a] v[b] over the first n components; a = -1: sums of v[b]; a = b = -1: the count.

    Each task adds up its own rows in numpy and gives one matrix; null and too short vectors are skipped.
    """
    import numpy as np
    import pyarrow as pa

    a, b = np.triu_indices(n + 1)

    def run(batches):
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            lists = [x[:n] for x in batch.column(0).to_pylist() if x is not None and len(x) >= n]
            if lists:
                x = np.insert(np.array(lists, float), 0, 1.0, axis=1)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(a - 1, pa.int64()), pa.array(b - 1, pa.int64()), pa.array(total[a, b], pa.float64())], names=["a", "b", "g"])

    return rows.select(v).mapInArrow(run, "a long, b long, g double").groupBy("a", "b").agg(F.sum("g").alias("g"))


def gramian(rows: DataFrame, n: int, v: str = "v") -> DataFrame:
    """Upper triangle of the sum of v v' over the first n components."""
    return moments(rows, n, v).where("a >= 0")


def fit_pca(rows: DataFrame, n: int, q: int, v: str = "v"):
    """(mean, basis of q columns, share of energy): from the n x n second moments, by numpy on the driver."""
    import numpy as np

    m = np.zeros((n + 1, n + 1))
    for r in moments(rows, n, v).collect():
        m[r["a"] + 1, r["b"] + 1] = m[r["b"] + 1, r["a"] + 1] = r["g"]
    mean = m[0, 1:] / m[0, 0]
    values, basis = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    values, basis = values[::-1], basis[:, ::-1]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), range(n)])
    return mean.tolist(), basis[:, :q], values[:q] / values.sum()


def project(v: Column, mean: list[float], basis) -> list[Column]:
    """(v - mean) . column for each column of a basis."""
    centred = F.zip_with(v, F.array(*map(F.lit, mean)), lambda a, b: a - b)
    return [dot(centred, F.array(*(F.lit(float(x)) for x in column))) for column in zip(*basis, strict=True)]


#: Centres of one broadcast array.
BLOCK = 4096


def blocks(centres: DataFrame) -> list[DataFrame]:
    """The vocabulary as tables of one row (_all: array in label order), each of about BLOCK centres, cut by label."""
    n = -(-centres.count() // BLOCK)
    listed = lambda part: part.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_all"))
    if n <= 1:
        return [listed(centres)]
    cuts = centres.stat.approxQuantile("label", [k / n for k in range(1, n)], 0.1 / n)
    low, high = [None, *cuts], [*cuts, None]
    inside = lambda a, b: (F.lit(True) if a is None else F.col("label") >= a) & (F.lit(True) if b is None else F.col("label") < b)
    return [listed(centres.where(inside(a, b))) for a, b in zip(low, high, strict=True)]


def assign(rows: DataFrame, centres: DataFrame, key: list[str], v: str = "v") -> DataFrame:
    """Each row's centre of the highest cosine (ties: the smallest label; a vector of zeros has cosine 0 to all), with residual and cosine.

    The vocabulary is broadcast in blocks of a bounded number of centres; a row keeps its best so far from block to block.
    """
    best = rows.withColumn("_b", F.lit(None))
    for k, part in enumerate(blocks(centres)):
        scored = F.transform("_all", lambda c: F.struct(cosine(F.col(v), c["c"]).alias("cos"), (-c["label"]).alias("m"), c["c"].alias("c")))
        found = F.array_max(scored)
        best = best.crossJoin(F.broadcast(part)).withColumn("_b", F.greatest(F.col("_b"), found) if k else found).drop("_all")
    return best.select(*key, (-F.col("_b.m")).alias("centre"), F.col("_b.cos").alias("cosine"), F.zip_with(v, F.col("_b.c"), lambda a, b: a - b).alias("residual"))


def vlad(assigned: DataFrame, group: str) -> DataFrame:
    """Rows (group, centre, d, x): residual sums, normalised per centre and then per group."""
    return normalised(group_sums(assigned, [group, "centre"], "residual").drop("n"), group)


def normalised(sums: DataFrame, group: str) -> DataFrame:
    """Rows (group, centre, d, x) at length 1 per centre, then per group; what has no length stays 0."""
    intra = sums.groupBy(group, "centre").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n"))
    once = sums.join(intra, [group, "centre"]).withColumn("x", F.coalesce(F.col("x") / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0))).drop("n")
    total = once.groupBy(group).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n"))
    return once.join(total, group).select(group, "centre", "d", F.coalesce(F.col("x") / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("x"))


def residuals(rows: DataFrame, centres: DataFrame, key: list[str], v: str = "v") -> DataFrame:
    """L1 distance of each row to each centre: an array in label order."""
    out = rows.withColumn("_far", F.array().cast("array<double>"))
    for part in blocks(centres):
        far = F.transform("_all", lambda c: F.aggregate(F.zip_with(F.col(v), c["c"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x))
        out = out.crossJoin(F.broadcast(part)).withColumn("_far", F.concat("_far", far)).drop("_all")
    return out.select(*key, F.col("_far").alias("residuals"))


def _near(column, centres):
    """Of an Arrow column of vectors: which are known, these as a matrix, the place of the centre of the highest cosine (the first of a tie) and that cosine.

    A vector of zeros has cosine 0 to all. centres: a matrix of the same width.
    """
    import numpy as np
    import pyarrow.compute as pc

    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    column = column.drop_null()
    if any(n != centres.shape[1] for n in pc.unique(pc.list_value_length(column)).to_pylist()):
        raise ValueError("vectors and centres differ in width")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centres, axis=1)
    cosine = np.divide(x @ centres.T, size, out=np.zeros_like(size), where=size != 0)
    at = cosine.argmax(1)
    return known, x, at, cosine[np.arange(len(x)), at]


def kmeans(rows: DataFrame, centres: DataFrame, rounds: int, v: str = "v", tol: float | None = None) -> DataFrame:
    """Centres (label, c, n) after rounds of Lloyd's algorithm by cosine; a centre without rows stays where it is, with n = 0.

    With tol, rounds end once no centre moves by more than that. A round is one pass with partial sums; centres, which are
    bounded, are collected after each, so that plans stay short.
    """
    import numpy as np
    import pyarrow as pa

    spark, schema = rows.sparkSession, "label long, c array<double>, n long"
    known = {r["label"]: (list(r["c"]), 0) for r in centres.select(F.col("label").cast("long").alias("label"), "c").collect()}
    vectors = rows.select(F.col(v).cast("array<double>").alias("v"))

    def summed(labels: np.ndarray, c: np.ndarray):
        """A task's own sums by centre, in numpy."""

        def run(batches):
            x, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                _, held, at, _ = _near(batch.column(0), c)
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                x[at[order][starts]] += np.add.reduceat(held[order], starts, axis=0) if len(at) else 0
                n += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(labels[some]), pa.array(list(x[some]), pa.list_(pa.float64())), pa.array(n[some])], names=["centre", "x", "n"])

        return run

    for _ in range(rounds if known else 0):
        labels = np.array(sorted(known))
        parts = vectors.mapInArrow(summed(labels, np.array([known[k][0] for k in labels.tolist()], float)), "centre long, x array<double>, n long")
        means = parts.select("centre", "n", F.posexplode("x").alias("d", "x")).groupBy("centre", "d").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
        found = {r["centre"]: (r["c"], r["n"]) for r in means.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n")).collect()}
        moved = max((sum((a - b) ** 2 for a, b in zip(c, known[k][0], strict=True)) ** 0.5 for k, (c, _) in found.items()), default=0.0)
        known = {k: found.get(k, (c, 0)) for k, (c, _) in known.items()}
        if tol is not None and moved <= tol:
            break
    return spark.createDataFrame([(k, c, n) for k, (c, n) in sorted(known.items())], schema)


def seed_centres(rows: DataFrame, k: int, key: str, v: str = "v", rounds: int = 5, oversample: int | None = None, tries: int = 10, seed: int = 0) -> DataFrame:
    """k centres (label, c) to start Lloyd's rounds from, by k-means||, for the distance 1 - cosine.

    Each round draws rows with a chance in proportion to their distance from the nearest centre so far, `oversample` (2 k) of
    them on average; a row's luck is a hash of key, round and seed, so the draw hangs on no partitioning. The candidates, at most a
    few oversample x rounds, are weighed by the rows nearest to them and cut to k on the driver, by the best of some tries of k-means++. Vectors of zeros and
    nulls are never drawn; fewer than k distinct vectors give fewer centres.
    """
    import numpy as np
    import pyarrow as pa

    spark, l = rows.sparkSession, oversample or 2 * k
    # Cosines do not hang on lengths, so only what is drawn is brought to length 1.
    rows = rows.select(F.col(key).alias("_key"), F.col(v).cast("array<double>").alias("v")).where(norm(F.col("v")) > 0)
    table = lambda cs: spark.createDataFrame([(n, c) for n, c in enumerate(cs)], "label long, c array<double>")
    luck = lambda r: F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(r)), F.lit(1 << 53)) / float(1 << 53)
    first = rows.orderBy(F.xxhash64("_key", F.lit(seed)), "_key").limit(1).select(unit(F.col("v")).alias("v")).collect()
    chosen = [list(r["v"]) for r in first]
    far = lambda cosine: np.maximum(1 - cosine, 0)

    def cost_of(c: np.ndarray):
        def run(batches):
            yield pa.record_batch([pa.array([float(sum(far(_near(b.column(0), c)[3]).sum() for b in batches))])], names=["d"])

        return run

    def weight_of(c: np.ndarray):
        def run(batches):
            n = sum((np.bincount(_near(b.column(0), c)[2], minlength=len(c)) for b in batches), np.zeros(len(c), np.int64))
            yield pa.record_batch([pa.array(np.arange(len(c))), pa.array(n)], names=["centre", "n"])

        return run

    def draw(c: np.ndarray, cost: float):
        """The rows whose luck is below their chance."""

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(b.column(1).to_numpy() < np.minimum(1.0, l * far(_near(b.column(2), c)[3]) / cost)))

        return run

    for r in range(rounds if chosen else 0):
        c = np.array(chosen)
        cost = rows.select("v").mapInArrow(cost_of(c), "d double").agg(F.sum("d")).first()[0] or 0.0
        if cost <= 1e-12:
            break
        drawn = rows.select("_key", luck(r).alias("_luck"), "v").mapInArrow(draw(c, cost), f"_key {rows.schema['_key'].dataType.simpleString()}, _luck double, v array<double>").select("_key", unit(F.col("v")).alias("v")).orderBy("_key").collect()
        chosen += [list(x["v"]) for x in drawn]
    if not chosen:
        return table([])
    weight = {r["centre"]: r["n"] for r in rows.select("v").mapInArrow(weight_of(np.array(chosen)), "centre long, n long").groupBy("centre").agg(F.sum("n").alias("n")).collect()}
    c, w = np.array(chosen), np.array([weight.get(n, 0) for n in range(len(chosen))], float)
    rng, best, least = np.random.default_rng(seed), None, np.inf
    for _ in range(tries):
        picked = [int(rng.choice(len(c), p=w / w.sum()))]
        far = 1 - c @ c[picked[0]]
        while len(picked) < k and (chance := w * np.maximum(far, 0)).sum() > 1e-12:
            picked.append(int(rng.choice(len(c), p=chance / chance.sum())))
            far = np.minimum(far, 1 - c @ c[picked[-1]])
        centres = c[picked]
        for _ in range(10):  # Lloyd's rounds among the candidates
            at = (c @ centres.T).argmax(1)
            sums = np.array([(w[at == n, None] * c[at == n]).sum(0) for n in range(len(centres))])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        cost = float((w * (1 - (c @ centres.T).max(1))).sum())
        if cost < least:
            best, least = centres, cost
    return table(best.tolist())


def range_pca(rows: DataFrame, n: int, q: int, v: str = "v", more: int = 10, rounds: int = 3, seed: int = 0, fan: int = 8):
    """(mean, basis of q columns, share of energy) as fit_pca gives them, for vectors too wide for an n x n matrix.

    A randomised range finder: rows times a thin matrix of q + more columns are made orthonormal by QR factors of each task,
    put together in a tree of `fan` at a time; rows against that basis give a thin matrix again, which starts the next round.
    What travels and what the driver holds is (q + more) x n numbers. Null and too short vectors are skipped.
    """
    import numpy as np
    import pyarrow as pa

    width = min(q + more, n)
    source = rows.select(v)

    def arrays(batches):
        for batch in batches:
            lists = [x[:n] for x in batch.column(0).to_pylist() if x is not None and len(x) >= n]
            if lists:
                yield np.array(lists, float)

    def add_up(table: pa.Table) -> pa.Table:
        return pa.table({"i": table.column("i")[:1], "x": pa.array([np.sum(np.array(table.column("x").to_pylist()), axis=0)])})

    def total(job) -> np.ndarray:
        """Sum over tasks of the matrices that job gives, row by row."""
        made = source.mapInArrow(lambda batches: (pa.record_batch({"i": pa.array(np.arange(len(m)), pa.int64()), "x": pa.array(list(m), pa.list_(pa.float64()))}) for m in job(arrays(batches))), "i long, x array<double>")
        return np.array([r["x"] for r in made.groupBy("i").applyInArrow(add_up, "i long, x array<double>").orderBy("i").collect()])

    def sums(parts):
        out = np.zeros((1, n + 2))
        for a in parts:
            out[0, :n] += a.sum(0)
            out[0, n:] += len(a), (a * a).sum()
        yield out

    (row,) = total(sums)
    mean, count, energy = row[:n] / row[n], row[n], row[n + 1]
    energy -= count * (mean @ mean)
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]

    def factor(thin):
        def job(batches):
            r = np.zeros((0, width))
            for a in arrays(batches):
                r = np.linalg.qr(np.vstack([r, (a - mean) @ thin]), mode="r")
            yield pa.record_batch({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

        def stacked(table: pa.Table) -> pa.Table:
            r = np.linalg.qr(np.vstack([np.array(x).reshape(-1, width) for x in table.column("r").to_pylist()]), mode="r")
            return pa.table({"r": pa.array([r.ravel()])})

        left = written(source.mapInArrow(job, "r array<double>"), "factors")
        parts = left.count()
        while parts > fan:
            parts = -(-parts // fan)
            left = left.groupBy(F.pmod(F.xxhash64("r"), F.lit(parts)).alias("_g")).applyInArrow(stacked, "r array<double>")
        return np.linalg.qr(np.vstack([np.array(r["r"]).reshape(-1, width) for r in left.collect()]), mode="r")

    for _ in range(rounds):
        r = factor(thin)
        size = np.abs(np.diag(r))
        keep = size > 1e-12 * max(size.max(), 1e-300)
        inverse = np.linalg.pinv(r) if not keep.all() else np.linalg.inv(r)

        def against(parts, thin=thin, inverse=inverse):
            out = np.zeros((width, n))
            for a in parts:
                a = a - mean
                out += (a @ thin @ inverse).T @ a
            yield out

        b = total(against)
        thin = np.linalg.qr(b.T)[0]
    _, values, vt = np.linalg.svd(b, full_matrices=False)
    basis = vt[:q].T
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), range(basis.shape[1])])
    return mean.tolist(), basis, values[:q] ** 2 / max(energy, 1e-300)


def norms(rows: DataFrame, mean: list[float], basis, v: str = "v") -> DataFrame:
    """One row: mean norms of the centred vectors, of their projection, of what is left, and the cumulative share of each component's mean size."""
    parts = project(F.col(v), mean, basis.tolist())
    centred = F.zip_with(v, F.array(*map(F.lit, mean)), lambda a, b: a - b)
    at = rows.select(dot(centred, centred).alias("_t"), F.array(*parts).alias("_p")).withColumn("_q", dot(F.col("_p"), F.col("_p")))
    rest = F.sqrt(F.greatest(F.col("_t") - F.col("_q"), F.lit(0.0)))
    sizes = [F.avg(F.abs(F.col("_p")[k])) for k in range(len(parts))]
    total = F.nullif(F.avg(F.sqrt("_t")), F.lit(0.0))
    steps = [sum(sizes[1 : k + 1], sizes[0]) / total for k in range(len(sizes))]
    return at.agg(F.avg(F.sqrt("_t")).alias("total"), F.avg(F.sqrt("_q")).alias("projected"), F.avg(rest).alias("residual"), F.array(*steps).alias("cumulative"))


def soft_vlad(rows: DataFrame, centres: DataFrame, group: str, temperature: float, v: str = "v") -> DataFrame:
    """Rows (group, centre, d, x): residuals to every centre weighted by softmax(temperature * cosine), normalised as in vlad."""
    weights = lambda near: F.transform("_all", lambda c: F.exp(temperature * cosine(F.col(v), c["c"])))
    listed, summed = blocks(centres), rows.withColumn("_s", F.lit(0.0))
    for part in listed:  # cosines lie in -1 .. 1, so the sum needs no running maximum
        summed = summed.crossJoin(F.broadcast(part)).withColumn("_s", F.col("_s") + F.aggregate(weights(summed), F.lit(0.0), lambda s, x: s + x)).drop("_all")
    shares = [_soft_sums(summed.crossJoin(F.broadcast(part)), group, temperature, v) for part in listed]
    parts = shares[0]
    for more in shares[1:]:
        parts = parts.unionByName(more)
    return normalised(parts.groupBy(group, "centre", "d").agg(F.sum("x").alias("x")), group)


def _soft_sums(near: DataFrame, group: str, temperature: float, v: str) -> DataFrame:
    """Rows (group, centre, d, x), several a sum: a task's weighted residuals to each centre of the block in _all, added up in numpy."""
    import numpy as np
    import pyarrow as pa

    kind, label = near.schema[group].dataType.simpleString(), near.schema["_all"].dataType.elementType["label"].dataType.simpleString()

    def unit_rows(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size == 0, 1.0, size)

    def run(batches):
        labels, c, held, types = None, None, {}, None
        for batch in batches:
            types = batch.schema.field(0).type, batch.schema.field(3).type.value_type.field("label").type
            if labels is None and batch.num_rows:
                block = batch.column(3)[0].as_py()
                labels, c = [x["label"] for x in block], np.array([x["c"] for x in block])
            groups, vectors, total = (batch.column(k).to_pylist() for k in range(3))
            by: dict = {}
            for n, (g, x) in enumerate(zip(groups, vectors, strict=True)):
                if x is not None:
                    by.setdefault(g, []).append(n)
            for g, at in by.items():
                x = np.array([vectors[n] for n in at], float)
                w = np.exp(temperature * (unit_rows(x) @ unit_rows(c).T)) / np.array([total[n] for n in at])[:, None]
                held[g] = held.get(g, 0.0) + w.T @ x - w.sum(0)[:, None] * c
            if len(held) * len(labels or ()) > HELD:
                yield from spread(held, labels, types)
                held = {}
        if held:
            yield from spread(held, labels, types)

    def spread(held, labels, types):
        for g, sums in held.items():
            yield pa.record_batch([pa.array([g] * len(labels), types[0]), pa.array(labels, types[1]), pa.array(list(sums), pa.list_(pa.float64()))], names=[group, "centre", "x"])

    sums = near.select(group, v, "_s", "_all").mapInArrow(run, f"`{group}` {kind}, centre {label}, x array<double>")
    return sums.select(group, "centre", F.posexplode("x").alias("d", "x"))


def reduced_vlad(sums: DataFrame, group: str) -> DataFrame:
    """Rows (group, d, x): the centres' parts of a VLAD added up and normalised."""
    added = sums.groupBy(group, "d").agg(F.sum("x").alias("x"))
    size = added.groupBy(group).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n"))
    return added.join(size, group).select(group, "d", F.coalesce(F.col("x") / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("x"))


def prototype_cosines(rows: DataFrame, prototypes: dict[str, list[float]], key: list[str], v: str = "v") -> DataFrame:
    """rows' key with one column a prototype: the cosine with it, 0 for a vector or prototype of zeros."""
    return rows.select(*key, *(cosine(F.col(v), F.array(*map(F.lit, p))).alias(name) for name, p in prototypes.items()))


def prototype_scores(rows: DataFrame, obstacles: list[list[float]], others: list[list[float]], key: list[str], v: str = "v") -> DataFrame:
    """Best cosine with an obstacle less the best with another prototype."""
    each = {f"_{side}{k}": p for side, ps in (("o", obstacles), ("n", others)) for k, p in enumerate(ps)}
    best = lambda side, ps: F.greatest(*(F.col(f"_{side}{k}") for k in range(len(ps)))) if len(ps) > 1 else F.col(f"_{side}0")
    return prototype_cosines(rows, each, key, v).select(*key, (best("o", obstacles) - best("n", others)).alias("obstacle_score"))


def confusion(rows: DataFrame, label: str, predicted: str, ignore: int = -1) -> DataFrame:
    """Per class: intersection, union, IoU, over rows whose label counts."""
    counts = rows.where(F.col(label) != ignore).groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("l").alias("k"), F.lit(1).alias("s")), F.struct(F.col("p").alias("k"), F.lit(2).alias("s")))).alias("e"), "l", "p", "n")
    per = sides.groupBy("e.k").agg(F.sum(F.when((F.col("l") == F.col("p")) & (F.col("e.s") == 1), F.col("n")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n") / 2).otherwise(F.col("n"))).alias("u"))
    return per.select(F.col("k").alias("class_id"), F.col("hit").cast("long").alias("intersection"), F.col("u").cast("long").alias("union_n"), (F.col("hit") / F.col("u")).alias("iou"))


def propagate(edges: DataFrame, target: str, label: str, k: int) -> DataFrame:
    """Labels of targets by the weights of their k heaviest edges (cos: affinity exp(cos / 0.1)); ties: smaller source."""
    order = Window.partitionBy(target).orderBy(F.col("cos").desc(), "source")
    top = edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).withColumn("_w", F.exp(F.col("cos") / 0.1))
    votes = top.groupBy(target, label).agg(F.sum("_w").alias("w"))
    return votes.groupBy(target).agg(F.max_by(label, F.struct(F.col("w"), -F.col(label))).alias("voted"), (F.max("w") / F.sum("w")).alias("share"))


def accuracy(rows: DataFrame, label: str, predicted: str, ignore: int = -1) -> DataFrame:
    """One row: rows whose label counts, and the share of them that is predicted right (null without any)."""
    counted = rows.where(F.col(label) != ignore)
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))


def means_only(pixels: DataFrame, pixel: list[str], mask: str, features: list[str]) -> DataFrame:
    """Rows (mask, n, features): means over the pixels that lie in that mask and in no other; pixels: one row a pixel and mask."""
    alone = pixels.groupBy(*pixel).agg(F.count_distinct(mask).alias("_n"), F.first(mask).alias(mask), *(F.first(f).alias(f) for f in features)).where("_n = 1")
    return alone.groupBy(mask).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in features))
