"""A training-data pipeline over `documents`: quality rules, toxicity, near duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of docs; the last returns pieces of
sequences. run() writes each stage's rows as Parquet into the shared folder and reads them again for the next, so a
lost executor costs no more than the stage at hand.

Null, empty and wordless texts fail the base rules of the first stage; the later stages, given such texts, keep them
(packing gives each one piece of one id). Rows with null id are documents like any other. Of rows that repeat an id and
its text one stays after the near-duplicate stage; of other ties the document of the least id. Labels with null id or
class are skipped. Empty tables pass through all stages. Other columns of documents come along unchanged, also those
named like an operator's results; only text and n_chars (where it exists) are written anew by substring dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.llm import doubling, jaccard, packing, quality, toxicity
from terravox.llm.common import documents, materialize

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, THRESHOLD = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _carrying(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all else as one struct, so that no column clashes with a result."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))


def _as_before(rows: DataFrame, docs: DataFrame, **written: Column) -> DataFrame:
    """The columns of docs again; those written take the place of what was there."""
    return rows.select(*(written.get(c, F.col("text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    return _as_before(quality.judge(_carrying(docs), _labels(spark, sf_dir)).where("kept"), docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the decision."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return _as_before(toxicity.score(_carrying(docs), model).where(F.col("score") < toxicity.DECISION), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of the least id (one without id where none has any); documents without words stay."""
    times = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(times.where("n > 1 or doc_id is null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        others = jaccard.join(docs, THRESHOLD, SHINGLE).where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    # Rows whose id is null or not theirs alone get a number of their own beyond all ids, so that each can stay or go by itself.
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    number = F.monotonically_increasing_id()
    key = F.lit((high or 0) + 1) + number if (high or 0) < 1 << 62 else F.lit(low - 1) - number
    same = docs["doc_id"].eqNullSafe(repeated["doc_id"])
    again = materialize(docs.join(repeated, same, "left_semi").withColumn("_key", key), "again")
    keyed = docs.join(repeated, same, "left_anti").withColumn("_key", F.col("doc_id").cast("long")).unionByName(again)
    groups = jaccard.join(keyed.select(F.col("_key").alias("doc_id"), "text"), THRESHOLD, SHINGLE).select(F.col("doc_id").alias("_key"), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    first = groups.join(keyed.select("doc_id", "_key"), "_key").groupBy("component_id").agg(F.min(rank).alias("m"))
    return keyed.join(first.select(F.col("m._key").alias("_key")), "_key", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated windows of words; a text that loses nothing is unchanged."""
    kept = doubling.dedup(_carrying(docs), carry=True)
    written = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        written["n_chars"] = F.length(written["text"]).cast(docs.schema["n_chars"].dataType)
    return _as_before(kept, docs, **written)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("packing", pack)]

#: SQL cannot express toxicity, nor packing's tokens: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
