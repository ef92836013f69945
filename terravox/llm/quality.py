"""Operator 9: quality rules, in DataFrame operations only.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. The method's verdict is a hashed
n-gram log-likelihood ratio: words and word pairs are hashed into a fixed number of buckets, one multinomial is counted
over the documents that labels trust and another over the raw corpus, and a document's mean log ratio per n-gram must
reach a fixed threshold. The bucket table is bounded, so it enters the scan as a constant: no text is shuffled.

The trusted side is fitted on at most TRUSTED_ROWS labelled rows (in order of a hash of their id); the raw side counts
every document. Documents without words have no n-grams: ratio 0, and they fail the base rules. Null texts are empty.
Without labels both multinomials are uniform or raw alike, and only the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, documents, let, literal_array, words_column

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
#: Mean natural-log ratio per n-gram below which a document goes.
THRESHOLD = -0.1
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose sequence is found twice or more in the array.

    Windows are hashed to 64 bits; 40 of them are packed with the position into one number, the numbers are sorted, and
    neighbours whose whole hashes agree are repeats. Arrays over 2^24 words are sorted with their whole hashes.
    """

    low = F.lit((1 << 24) - 1)

    def positions(win: Column) -> Column:
        def repeats(s: Column, alike) -> Column:
            """Neighbours in the sorted array that are alike."""
            return F.filter(F.arrays_zip(s.alias("a"), F.slice(s, 2, F.size(s)).alias("b")), alike)

        def at(x: Column) -> Column:
            return x.bitwiseAND(low).cast("int")

        packed = F.sort_array(F.transform(win, lambda h, i: F.shiftleft(F.shiftright(h, 24), 24).bitwiseOR(i.cast("bigint"))))
        near = let(packed, lambda s: repeats(s, lambda x: x["a"].bitwiseXOR(x["b"]).between(F.lit(0), low)))
        short = F.transform(F.filter(near, lambda x: win[at(x["a"])] == win[at(x["b"])]), lambda x: F.array(at(x["a"]), at(x["b"])))
        whole = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
        long = F.transform(let(whole, lambda s: repeats(s, lambda x: x["a"]["h"] == x["b"]["h"])), lambda x: F.array(x["a"]["i"], x["b"]["i"]))
        return F.flatten(F.when(F.size(win) < (1 << 24), short).otherwise(long))

    triples = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c"))
    windows = F.slice(F.transform(triples, lambda x: F.xxhash64(x)), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    found = let(windows, positions)
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2)))))


def pairs_of(words: Column) -> Column:
    """Each word with the next; the last word's partner is null, which adds nothing to a hash."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))


def buckets_of(pair: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket of the word and bucket of the pair: two n-grams for each word of a text."""
    return F.pmod(F.xxhash64(pair["a"]), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(pair), F.lit(buckets)).cast("int")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base rules' figures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("words", words_column(text))
        .withColumns({
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")).cast("long"),
        })
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """log(trusted share / raw share) of each bucket; the counted table has at most `buckets` rows."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    pairs = flagged.select("trusted", words_column("text").alias("words")).select("trusted", F.explode(pairs_of(F.col("words"))).alias("pair"))
    grams = pairs.select("trusted", F.explode(F.array(*buckets_of(F.col("pair"), buckets))).alias("bucket"))
    raw, good = [0] * buckets, [0] * buckets
    for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("trusted").alias("t")).collect():
        raw[r["bucket"]], good[r["bucket"]] = r["n"], r["t"]
    if not sum(good):
        return [0.0] * buckets
    # Both sides take the raw shares as their prior, so that a bucket unseen by the trusted side falls by a bounded amount.
    n, t = sum(raw), sum(good)
    prior = SMOOTHING * buckets
    return [math.log((g + prior * (r + 1) / (n + buckets)) / (t + prior)) - math.log((r + 1) / (n + buckets)) for g, r in zip(good, raw, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with the base figures, llr (mean log ratio) and kept."""
    docs = docs.drop("words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    table = literal_array(log_ratios(docs, labels, buckets), "double")
    one, two = (lambda x: F.get(table, buckets_of(x, buckets)[0])), (lambda x: F.get(table, buckets_of(x, buckets)[1]))
    total = F.aggregate(pairs_of(F.col("words")), F.lit(0.0), lambda acc, x: acc + (one(x) + two(x)))
    llr = F.when(F.col("n_words") > 0, total / (2 * F.greatest(F.col("n_words"), F.lit(1)))).otherwise(0.0)
    return base_columns(docs).withColumn("llr", llr).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
