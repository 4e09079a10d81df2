"""Sharding by fixed virtual slots: records hash to slots, a small versioned map says which shard has a slot."""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import new_path
from .common import spread, written

#: Virtual slots. The map has one row per slot, so this also bounds what the driver sees and what is broadcast.
SLOTS = 4096

MAP_SCHEMA = T.StructType(
    [
        T.StructField("vslot", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()),
    ]
)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one for the record's end; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_slot(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds ``vslot``. Checksum and copy number are part of the key, so rows that share a doc_id, or all, still spread."""
    return records.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def slot_totals(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot that has rows: as many as there are slots at most."""
    totals = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return sorted((r.vslot, r.bytes, r.rows) for r in totals.collect())


def build_map(totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slots by falling bytes, each to the lightest shard."""
    loads, out = [(0, s) for s in range(shards)], {}
    for slot, size, _ in sorted(totals, key=lambda t: (-t[1], t[0])):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def rebalance(totals: list[tuple[int, int, int]], old: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """A new version of the map for other totals or more shards that moves few slots.

    Slots without a shard go to the lightest one; then, while some shard is over the mean by more than ``slack``,
    its largest slot that still fits goes to the lightest shard. Slots that need not move stay where they are.
    """
    size = {slot: b for slot, b, _ in totals}
    new = {slot: s for slot, s in old.items() if slot in size and s < shards}
    load = [0] * shards
    for slot, s in new.items():
        load[s] += size[slot]
    for slot in sorted(size.keys() - new.keys(), key=lambda x: (-size[x], x)):
        new[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[new[slot]] += size[slot]
    mean = sum(load) / shards
    while True:
        full, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        fits = [x for x, s in new.items() if s == full and 0 < size[x] < load[full] - load[light]]
        if load[full] <= mean * (1 + slack) or not fits:
            return new
        over = load[full] - mean
        slot = min(fits, key=lambda x: (abs(size[x] - over), x))
        new[slot] = light
        load[full], load[light] = load[full] - size[slot], load[light] + size[slot]


def map_frame(spark: SparkSession, totals: list[tuple[int, int, int]], shard_of: dict[int, int]) -> DataFrame:
    """The map as a table of at most SLOTS rows; ``first`` is where the slot's rows begin in their shard."""
    rows, begin = [], {}
    for slot, size, n in totals:
        s = shard_of[slot]
        rows.append((slot, size, n, s, begin.get(s, 0)))
        begin[s] = begin.get(s, 0) + n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(frame: DataFrame, path: str, version: int) -> None:
    """Keep a version of the map; an existing version is never overwritten."""
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).drop("version")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last stored version; None if nothing has been stored."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def next_map(spark: SparkSession, totals: list[tuple[int, int, int]], shards: int, path: str) -> DataFrame:
    """Store the next version of the map at ``path`` and give it: the last one edited for the new totals, so that few
    slots move, or a fresh one where there is none."""
    last = latest_version(spark, path)
    if last is None:
        shard_of = build_map(totals, shards)
    else:
        shard_of = rebalance(totals, {r.vslot: r.shard for r in load_map(spark, path, last).collect()}, shards)
    version = 1 if last is None else last + 1
    store_map(map_frame(spark, totals, shard_of), path, version)
    return load_map(spark, path, version)


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every document with its shard under the law ``bytes``: sizes of shards are near equal.

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null:
    only the law ``key`` has one), vslot. Null texts count one byte and have checksum 0; null and repeated doc_ids
    are records like others, and rows that are alike in all are told apart by a copy number, so a row that stands in
    a third of the table is dealt to all slots; a long text is one record of its size; an empty table gives no rows.
    Other columns of ``docs`` are not read.

    The slot-to-shard map is kept at ``path`` in versions (a new folder in the shared one by default): a later call
    edits the last version for the totals of its own documents. Texts are read once; what is shuffled, for copy
    numbers and for places, holds none. No shard, source or repeated row is ever a group: places are counted within
    virtual slots and moved by the slot's beginning in its shard.
    """
    spark = docs.sparkSession
    records = docs.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    counted = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    slotted = written(with_slot(spread(counted, "times", "copy"), slots), "records")
    shard_map = next_map(spark, slot_totals(slotted), shards, path or new_path(spark, "slot-map"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy")
    placed = slotted.withColumn("place", F.row_number().over(within) - 1)
    return placed.join(F.broadcast(shard_map.select("vslot", "shard", "first")), "vslot").select(  # a row for each slot
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
