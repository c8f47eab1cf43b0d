"""Sharding by fixed virtual slots, with a versioned slot-to-shard map.

Records are hashed into slots whose number never changes.  Bytes are added up
per slot, the map gives each slot a shard, and rebalancing edits the map: only
rows of the slots it names move.  Rows that repeat are numbered, and the number
is hashed too, so that they spread over the slots like any others.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes
from musterroll.runtime import new_folder, written

SLOTS = 4096
LAW = "bytes"
ROW_COST = 8  # bytes that a row takes besides its text


def record_hash() -> Column:
    """Hash of id and text; rows without an id go by their text alone."""
    return F.xxhash64("doc_id", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, counted from 0 among the rows of equal ``hash``.

    ``rows`` is a written table with ``hash`` and ``part``, the task that wrote
    the row.  Equal rows are counted part by part, and each part goes on where
    those before it end, so no task holds more of them than one part has.
    Rows of a hash of their own are not shuffled by it.
    """
    several = written(rows.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("hash"), "repeated")
    many = rows.join(several, "hash", "left_semi")
    along = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy("hash", "part").agg(F.count("*").alias("n"))
    starts = written(parts.select("hash", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start")), "repeat-starts")
    within = Window.partitionBy("hash", "part").orderBy("hash")
    counted = many.withColumn("place", F.row_number().over(within) - 1).join(starts, ["hash", "part"])
    counted = counted.withColumn("copy", F.col("start") + F.col("place")).select(*rows.columns, "copy")
    alone = rows.join(several, "hash", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return alone.unionByName(counted)


def slot_of(slots: int) -> Column:
    """Slot by ``hash`` and ``copy``; the first of equal rows goes by its hash alone."""
    place = F.when(F.col("copy") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "copy"))
    return F.pmod(place, F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, hash, copy, vslot`` of every row; a null text is empty."""
    data = text_bytes(F.col("text"))
    slim = docs.select(
        "doc_id",
        (F.octet_length(data) + F.lit(ROW_COST)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        record_hash().alias("hash"),
        F.spark_partition_id().alias("part"),
    )
    return numbered(written(slim, "shard-rows")).drop("part").withColumn("vslot", slot_of(slots))


def slot_sizes(placed: DataFrame) -> DataFrame:
    """Bytes and rows per slot: never more rows than there are slots."""
    return placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes; empty slots are dealt in turn."""
    load = [(0, shard) for shard in range(shards)]
    given = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        held, shard = heapq.heappop(load)
        given[slot] = shard
        heapq.heappush(load, (held + sizes[slot], shard))
    return given | {slot: slot % shards for slot in range(slots) if slot not in given}


def edited(sizes: dict[int, int], given: dict[int, int], shards: int) -> dict[int, int]:
    """The map after moving slots from the fullest to the emptiest shard.

    Each move takes the slot whose size is nearest to half the gap between
    the two, and is made only if it narrows the gap; so few rows move.
    """
    given = dict(given)
    held = [0] * shards
    inside: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in given.items():
        held[shard] += sizes.get(slot, 0)
        if sizes.get(slot, 0):
            inside[shard].add(slot)
    while True:
        full, empty = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        gap = held[full] - held[empty]
        fits = [s for s in inside[full] if sizes[s] < gap]
        if not fits:
            return given
        slot = min(fits, key=lambda s: (abs(2 * sizes[s] - gap), s))
        inside[full].remove(slot)
        inside[empty].add(slot)
        held[full] -= sizes[slot]
        held[empty] += sizes[slot]
        given[slot] = empty


class SlotMap:
    """Versions of a slot-to-shard map in a shared folder, one small table per version.

    A map has one row per slot (``SLOTS``), which is what the driver handles;
    records never pass through it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, slots: int = SLOTS):
        self.spark, self.slots = spark, slots
        self.folder = folder or new_folder(spark, "slot-map")

    def save(self, version: int, given: dict[int, int], shards: int) -> None:
        rows = [(version, shards, slot, shard) for slot, shard in sorted(given.items())]
        frame = self.spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")
        frame.coalesce(1).write.parquet(f"{self.folder}/version={version}")

    def table(self, version: int) -> DataFrame:
        schema = "shards int, vslot int, shard int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/version={version}").select("vslot", "shard")

    def load(self, version: int) -> dict[int, int]:
        return {r.vslot: r.shard for r in self.table(version).collect()}

    def create(self, sizes: DataFrame, shards: int) -> int:
        """Version 1, balanced for the sizes at hand."""
        known = {r.vslot: r.bytes for r in sizes.collect()}
        self.save(1, edited(known, first_map(known, shards, self.slots), shards), shards)
        return 1

    def rebalance(self, sizes: DataFrame, version: int, shards: int) -> int:
        """The next version, edited for new sizes or more shards; fewer shards deal out those that go."""
        known = {r.vslot: r.bytes for r in sizes.collect()}
        old = {slot: shard if shard < shards else slot % shards for slot, shard in self.load(version).items()}
        self.save(version + 1, edited(known, old, shards), shards)
        return version + 1


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """Shard of every row, and its place in the shard, counted from 0.

    Sizes of shards are near equal (law ``bytes``).  The place is counted in
    two steps, slot by slot and then in the slot, so no task holds a whole
    shard.  Rows without an id or a text are placed like any other; rows that
    repeat each take a place, in slots of their own, whatever their number.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    placed = written(with_slots(docs, slots), "sharded")
    sizes = slot_sizes(placed)
    slot_map = slot_map or SlotMap(spark, slots=slots)
    map_table = slot_map.table(slot_map.create(sizes, shards))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = map_table.join(sizes.select("vslot", "rows"), "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    # A map has SLOTS rows, whatever the data.
    rows = placed.join(F.broadcast(starts), "vslot")
    within = Window.partitionBy("vslot").orderBy("hash", "copy", "doc_id", "text_crc32", "size")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write every column of ``docs`` under ``path/shard=N``.

    Rows are dealt out by slot, so a shard is written by many tasks; equal
    rows are numbered as in ``sharded`` and so fill the same slots.
    """
    given = [F.col(c).alias(f"__{k}") for k, c in enumerate(docs.columns) if c != "shard"]
    rows = written(docs.select(*given, record_hash().alias("hash"), F.spark_partition_id().alias("part")), "shard-rows")
    placed = numbered(rows).withColumn("vslot", slot_of(slots)).join(F.broadcast(slot_map), "vslot")
    named = [F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns) if c != "shard"]
    placed.repartition("shard", "vslot").select(*named, "shard").write.partitionBy("shard").parquet(path)
