"""Shards by fixed virtual slots: records hash to slots, slots map to shards, and the map is edited to rebalance.

The law is ``bytes``: shards hold nearly equal numbers of bytes.  A record's slot depends on the record alone and never
changes; of rows equal in id and text every further ``COPIES`` rows or ``COPY_BYTES`` bytes have a slot of their own, so a
row that repeats very often is spread over the slots.  One aggregation gives the bytes and rows of each slot; the largest slots are dealt first, each to the lightest
shard.  The map is stored with a version number; a later version moves as few bytes as the new balance needs.

Defined cases: a null text has one byte (its end) like an empty one; rows that are equal in id and text share a slot up to
the numbers above, and are placed one after another; rows of null id are hashed by their text; slots of equal bytes are
dealt in the order of their numbers; a single text larger than a shard's share leaves its shard that much larger; an empty
table has an empty result and a map of empty slots; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from caretide.llm import storage

SLOTS = 4096  #: bounds the aggregate, the map and the broadcast of it
PARTS = 16  #: parts of a slot in which rows are numbered
COPIES, COPY_BYTES = 1024, 1 << 16  #: equal rows that stay together
LAW = "bytes"


@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot, at one version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, slot_bytes: list[int], shards: int) -> SlotMap:
        """Version 1: largest slots first, each to the shard with the fewest bytes."""
        load = [(0, s) for s in range(shards)]
        shard_of = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
            held, shard = heapq.heappop(load)
            shard_of[slot] = shard
            heapq.heappush(load, (held + slot_bytes[slot], shard))
        return cls(1, shards, tuple(shard_of))

    def rebalanced(self, slot_bytes: list[int], shards: int | None = None) -> SlotMap:
        """The next version: slots of shards that no longer exist go, then overfull shards give slots to the lightest.

        A slot moves only if that brings both shards nearer to the mean.
        """
        shards = shards or self.shards
        mean = sum(slot_bytes) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        moving = []
        for slot, shard in enumerate(self.shard_of):
            (held[shard] if shard < shards else moving).append(slot)
        load = [sum(slot_bytes[k] for k in own) for own in held]
        for shard, own in enumerate(held):
            for slot in sorted(own, key=lambda k: (-slot_bytes[k], k)):
                if slot_bytes[slot] and load[shard] - slot_bytes[slot] >= mean:
                    moving.append(slot)
                    load[shard] -= slot_bytes[slot]
        shard_of = list(self.shard_of)
        lightest = [(b, s) for s, b in enumerate(load)]
        heapq.heapify(lightest)
        for slot in sorted(moving, key=lambda k: (-slot_bytes[k], k)):
            b, shard = heapq.heappop(lightest)
            shard_of[slot] = shard
            heapq.heappush(lightest, (b + slot_bytes[slot], shard))
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version beside the earlier ones; an existing version is never overwritten."""
        self.frame(spark).write.mode("error").parquet(f"{path}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, the newest by default."""
        known = spark.read.option("basePath", path).schema("shards int, virtual_slot int, shard int, version int").parquet(path)
        version = version or known.agg(F.max("version")).first()[0]
        rows = sorted(tuple(r) for r in known.where(F.col("version") == version).select("virtual_slot", "shard", "shards").collect())
        return cls(version, rows[0][2], tuple(r[1] for r in rows))


def records(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of every row."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def spread(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The same rows, with equal ones beyond the numbers above in further slots.

    Equal rows are counted, which sums before the shuffle, and written out again from pieces of bounded size.
    """
    most = F.greatest(F.lit(1), F.least(F.lit(COPIES), F.floor(F.lit(COPY_BYTES) / F.col("size")))).cast("long")
    counted = rows.groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count("*").alias("__n")).withColumn("__most", most)
    pieces = counted.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / F.col("__most")).cast("long"))))
    slot = F.when(F.col("__piece") == 0, F.col("virtual_slot")).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32", "__piece"), F.lit(slots)).cast("int"))
    held = F.least(F.col("__most"), F.col("__n") - F.col("__piece") * F.col("__most"))
    # pieces go to other tasks before they are written out, or one task would write a third of all rows
    dealt = pieces.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), held.alias("__held")).repartition(storage.shuffle_partitions(rows.sparkSession), "virtual_slot")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__held")))).drop("__held", "__copy")


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot; the driver gets one row for each slot that has any."""
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    return [found.get(k, (0, 0))[0] for k in range(slots)], [found.get(k, (0, 0))[1] for k in range(slots)]


def place(rows: DataFrame, slot_map: SlotMap, slot_rows: list[int]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard: rows of lower virtual slots first.

    Rows are numbered in ``PARTS`` parts of each slot; the counts of earlier parts, of which there are few, are added.
    """
    spark, filled, base = rows.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        base.append((slot, shard, filled[shard]))
        filled[shard] += slot_rows[slot]
    bases = F.broadcast(spark.createDataFrame(base, "virtual_slot int, shard int, __base long"))
    parted = rows.withColumn("__part", F.pmod(F.hash("doc_id", "text_crc32", "size"), F.lit(PARTS)))
    counts = parted.groupBy("virtual_slot", "__part").agg(F.count("*").alias("__rows"))
    earlier = F.coalesce(F.sum("__rows").over(Window.partitionBy("virtual_slot").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(counts.select("virtual_slot", "__part", earlier.alias("__before")))  # at most PARTS rows a slot
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "__part").orderBy("doc_id", "text_crc32", "size"))
    placed = parted.withColumn("__nth", nth).join(before, ["virtual_slot", "__part"]).join(bases, "virtual_slot")
    return placed.withColumn("slot", F.col("__base") + F.col("__before") + F.col("__nth") - 1).drop("__base", "__before", "__nth", "__part")


def query(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All ``documents`` in shards of nearly equal bytes, through a stored map."""
    rows = storage.materialize(spread(records(storage.table(spark, sf_dir, "documents"))), "slots", compression="zstd")
    slot_bytes, slot_rows = slot_sums(rows)
    path = storage.new_path(spark, "slot-map")
    SlotMap.balanced(slot_bytes, shards).save(spark, path)
    slot_map = SlotMap.load(spark, path)
    placed = place(rows, slot_map, slot_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
