"""Sharding by fixed virtual slots.

A record's slot is a hash of its key, one of some thousands, and never changes. A versioned table maps
slots to shards. Growing by a shard edits the table: the new shard takes a few slots from each of the others,
so rows move only into it. Rebalancing edits it too, by the bytes that were counted per slot. The law is
``key``: with an untouched or grown map, key and number of shards decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.session import shared_dir

SLOTS = 4096
PARTS = 16  # of a slot, by content and by place in the input, so that one key's rows are numbered in many tasks


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; null has one as well."""
    return F.pmod(F.xxhash64(key, F.lit(9)), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """``version, slot, shard``: version 1, the slots dealt out in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("slot"), (slot % shards).cast("int").alias("shard"))


def latest(slot_map: DataFrame) -> DataFrame:
    """The rows of the highest version."""
    last = slot_map.agg(F.max("version").alias("version"))
    return slot_map.join(F.broadcast(last), "version", "left_semi")


def grown(slot_map: DataFrame) -> DataFrame:
    """The next version, with one more shard that takes an equal part of each other shard's slots."""
    now = latest(slot_map)
    shards = (now.agg(F.max("shard")).first()[0] or 0) + 1
    order = Window.partitionBy("shard").orderBy(F.xxhash64("slot", F.lit(17)), "slot")
    size = Window.partitionBy("shard")
    moves = F.row_number().over(order) <= F.floor(F.count("*").over(size) / (shards + 1))
    return now.select((F.col("version") + 1).alias("version"), "slot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version, with slots moved from shards above the mean to those below it.

    ``loads`` has ``slot, bytes``. Shards above the mean give up slots, the smallest first, while what they
    have given stays within what they have too much; these slots fill the gaps of the others in
    order. A slot is never split. The map has one row per slot, so its windows are small whatever the data.
    """
    now = latest(slot_map).join(loads.select("slot", "bytes"), "slot", "left").fillna({"bytes": 0})
    by_shard = now.groupBy("shard").agg(F.sum("bytes").alias("load"))
    by_shard = by_shard.withColumn("mean", F.lit(by_shard.agg(F.avg("load")).first()[0]))
    small_first = Window.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    given = (
        now.join(by_shard.where("load > mean"), "shard").withColumn("given", F.sum("bytes").over(small_first))
        .where("given <= load - mean and bytes > 0")
    )
    everything = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    given = given.select("slot", "bytes").withColumn("upto", F.sum("bytes").over(everything))
    gaps = by_shard.where("load < mean").select("shard", (F.col("mean") - F.col("load")).alias("room"))
    filled = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    gaps = gaps.withColumn("end", F.sum("room").over(filled)).withColumn("start", F.col("end") - F.col("room"))
    middle = F.col("upto") - F.col("bytes") / 2
    moved = given.join(F.broadcast(gaps), (middle >= F.col("start")) & (middle < F.col("end"))).select("slot", F.col("shard").alias("to"))
    return now.join(moved, "slot", "left").select(
        (F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard")
    )


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Appends a version to the stored map and returns all versions; those stored before stay as they are."""
    slot_map.coalesce(1).write.mode("append").parquet(path)
    return slot_map.sparkSession.read.schema("version int, slot int, shard int").parquet(path)


def sharded(documents: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Shard of every row of ``documents`` (``doc_id``, ``text``), with ``shards`` shards and with one more.

    ``size`` is the UTF-8 bytes of the text plus 1, a null text has none; ``text_crc32`` that of an empty
    text then. ``slot`` numbers the rows of a shard without gaps from 0, ``virtual_slot`` is the fixed slot
    and ``slot_bytes`` the bytes counted in it. Null ids are a key like any other; repeated rows share a shard and get
    places of their own. The versions of the slot map are stored at ``path``, else in shared space.
    """
    spark = documents.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
    )
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)) * PARTS + F.spark_partition_id() % PARTS
    rows = written(rows.withColumn("part", part.cast("int")), "shard-rows")  # narrow; fixes the parts for what follows

    path = path or shared_dir(spark, "slot-map")
    store_map(initial_map(spark, shards, slots), path)
    versions = store_map(grown(spark.read.schema("version int, slot int, shard int").parquet(path)), path)
    first = versions.where("version = 1").select(F.col("slot").alias("virtual_slot"), "shard")
    more = versions.where("version = 2").select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("grown_shard"))
    shard_map = F.broadcast(first.join(more, "virtual_slot"))  # one row per slot

    counted = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # Numbers of the parts: running sums inside a slot, then over a shard's slots; both over counts, not rows.
    in_slot = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("virtual_slot")
    parts = counted.select(
        "virtual_slot", "part", F.coalesce(F.sum("n").over(in_slot), F.lit(0)).alias("before"), F.sum("bytes").over(whole).alias("slot_bytes")
    )
    by_slot = counted.groupBy("virtual_slot").agg(F.sum("n").alias("n")).join(shard_map, "virtual_slot")
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slot.select(
        "virtual_slot", "shard", "grown_shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("start")
    )
    starts = parts.join(F.broadcast(starts), "virtual_slot")  # at most one row per slot
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return rows.withColumn("place", place).join(starts, ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("before") + F.col("place")).cast("long").alias("slot"),
        "grown_shard", "virtual_slot", "slot_bytes",
    )
