"""Operator 7: sharding by fixed virtual slots, in DataFrame operations only.

Each record is hashed into one of thousands of virtual slots; bytes are added up per slot; a versioned map says which
shard a slot belongs to. Version 1 deals slots out in turn. A rebalance edits it: slots move from the heaviest shard to
the lightest until no move makes them more equal, and the edited map is the next version. Only the slot table, which is
bounded by the number of slots, reaches the driver; records never move but by their slot.

Null texts hold no bytes (crc32 0). Null ids and repeated rows are hashed with size and crc32 of the text. An empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, literal_array, shared_folder

SHARDS = 24
VIRTUAL_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]


def first_map(shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
    return SlotMap(1, shards, tuple(s % shards for s in range(slots)))


def rebalance(old: SlotMap, weights: list[int], shards: int | None = None) -> SlotMap:
    """The next version: slots (with their weights) move from the heaviest shard to the lightest while that lessens the difference."""
    shards = shards or old.shards
    held: list[list[int]] = [[] for _ in range(shards)]
    shard_of = [s if s < shards else slot % shards for slot, s in enumerate(old.shard_of)]
    for slot, shard in enumerate(shard_of):
        held[shard].append(slot)
    load = [sum(weights[s] for s in own) for own in held]
    while True:
        heavy = max(range(shards), key=lambda i: (load[i], -i))
        light = min(range(shards), key=lambda i: (load[i], i))
        gap = load[heavy] - load[light]
        # Half the gap is the best weight to move; less than the whole gap is an improvement.
        movable = [s for s in held[heavy] if 0 < weights[s] < gap]
        if not movable:
            return SlotMap(old.version + 1, shards, tuple(shard_of))
        slot = min(movable, key=lambda s: (abs(2 * weights[s] - gap), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        shard_of[slot] = light
        load[heavy] -= weights[slot]
        load[light] += weights[slot]


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append this version to the table of maps."""
    rows = spark.range(len(slot_map.shard_of)).select(F.lit(slot_map.version).alias("version"), F.lit(slot_map.shards).alias("shards"), F.col("id").cast("int").alias("slot"), literal_array(slot_map.shard_of, "int")[F.col("id").cast("int")].alias("shard"))
    rows.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest if none is named. The table is bounded by versions and slots."""
    table = spark.read.parquet(path)
    version = version or table.agg(F.max("version")).first()[0]
    rows = sorted((r["slot"], r["shard"], r["shards"]) for r in table.where(F.col("version") == version).collect())
    return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def records(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, virtual_slot)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(sized: DataFrame, slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot: a table of at most `slots` rows, brought to the driver."""
    size, count = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    return size, count


def place(sized: DataFrame, slot_map: SlotMap, count: list[int]) -> DataFrame:
    """Records with the shard that the map gives their virtual slot, and their place in it (slot, gapless from 0)."""
    first, filled = [], [0] * slot_map.shards
    for slot, s in enumerate(slot_map.shard_of):
        first.append(filled[s])
        filled[s] += count[slot]
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return sized.withColumn("within", within).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        literal_array(slot_map.shard_of, "int")[F.col("virtual_slot")].alias("shard"),
        (literal_array(first, "bigint")[F.col("virtual_slot")] + F.col("within") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Records placed by the newest map of the table at path, and that map.

    Without a path a new table with version 1 is written into the shared folder. The newest version is edited
    by the bytes of these slots, the edit is appended as the next version, and records are placed by what is read back.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        save_map(spark, first_map(shards, slots), path)
    sized = records(docs, slots)
    size, count = slot_sizes(sized, slots)
    save_map(spark, rebalance(load_map(spark, path), size, shards), path)
    stored = load_map(spark, path)
    return place(sized, stored, count), stored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))[0]
