"""Sharding over fixed virtual slots.

A record's slot is a hash of its id modulo SLOTS, for good.  Bytes are added up per slot, and a versioned
slot-to-shard map says where each slot's records lie.  Balancing and growing edit the map only: they move
few slots and never rehash a record.

The law kept is `bytes`: a new map hands out the slots, largest first, each to the lightest shard, so that
shards differ by less than their largest slot.  An id (or null) with more bytes than the mean slot would make
a slot that no map can level: there are fewer such ids than slots, and their records are hashed with their
row numbers, each to a slot of its own; the placement tells where each went.

Places in a shard are numbered within blocks, the records that one task wrote, so that neither a shard nor a
common id is numbered in one task.

Defined results: a null text has size 8; records of a null id share the slot of null unless they outweigh
it; repeated rows are placed each; an empty table has an empty placement and a map that deals the slots out
evenly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.shared import scratch_dir, stored

SLOTS, OVERHEAD = 8192, 8


def slot_of(*record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """shard[k] is where slot k lies; every edit has the next version."""

    version: int
    shards: int
    shard: np.ndarray

    @staticmethod
    def build(weight: np.ndarray, shards: int) -> SlotMap:
        """Largest slot first, each to the lightest shard; slots of equal weight in order of slot."""
        load = [(0, 0, s) for s in range(shards)]
        shard = np.zeros(len(weight), np.int32)
        for k in np.lexsort((np.arange(len(weight)), -weight)):
            w, n, s = heapq.heappop(load)
            shard[k] = s
            heapq.heappush(load, (w + int(weight[k]), n + 1, s))
        return SlotMap(1, shards, shard)

    def grown(self, weight: np.ndarray, shards: int) -> SlotMap:
        """The next version over more shards: slots only move into the new ones, until these hold their fair share."""
        shard = self.shard.copy()
        load = np.bincount(shard, weights=weight, minlength=shards).astype(np.int64)
        fair = load.sum() / shards
        order = np.lexsort((np.arange(len(weight)), -weight))
        for new in range(self.shards, shards):
            for k in order:
                if load[new] >= fair:
                    break
                old = shard[k]
                if old < self.shards and load[old] - weight[k] >= fair * 0.999 and load[new] + weight[k] <= fair * 1.001:
                    load[old] -= weight[k]
                    load[new] += weight[k]
                    shard[k] = new
        return SlotMap(self.version + 1, shards, shard)

    def rebalanced(self, weight: np.ndarray, slack: float = 0.01) -> SlotMap:
        """The next version over as many shards: slots move from the heaviest to the lightest while that levels them."""
        shard = self.shard.copy()
        load = np.bincount(shard, weights=weight, minlength=self.shards).astype(np.int64)
        for _ in range(len(shard)):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            if gap <= slack * load.mean():
                break
            mine = np.flatnonzero((shard == high) & (weight > 0) & (weight < gap))
            if not len(mine):
                break
            k = mine[np.abs(weight[mine] - gap / 2).argmin()]
            shard[k] = low
            load[high] -= weight[k]
            load[low] += weight[k]
        return SlotMap(self.version + 1, self.shards, shard)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, k, int(s)) for k, s in enumerate(self.shard)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map's table, the latest unless one is named."""
        kept = spark.read.parquet(path)
        version = kept.agg(F.max("version")).head()[0] if version is None else version
        rows = kept.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0].shards, np.array([r.shard for r in rows], np.int32))


def records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, row): what placing needs; texts go no further.  row is the writing task and the number there."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), slot_of(F.col("doc_id"), slots=slots).alias("virtual_slot"), F.monotonically_increasing_id().alias("row"))


def spread(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """found with the records of ids that outweigh the mean slot dealt over all slots by row."""
    mean = (found.agg(F.sum("size")).first()[0] or 0) / slots
    full = found.groupBy("virtual_slot").agg(F.sum("size").alias("w")).filter(F.col("w") > 2 * mean).select("virtual_slot")
    heavy = found.join(full, "virtual_slot", "left_semi").groupBy("doc_id").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    heavy = heavy.filter((F.col("w") > mean) & (F.col("n") > 1)).select(F.col("doc_id").alias("heavy_id"), F.lit(True).alias("heavy"))  # fewer than slots
    marked = found.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("heavy_id")), "left")
    slot = F.when(F.col("heavy"), slot_of(F.col("doc_id"), F.col("row"), slots=slots)).otherwise(F.col("virtual_slot"))
    return marked.withColumn("virtual_slot", slot).drop("heavy", "heavy_id")


def slot_weights(found: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes of each slot; the sums are as many as there are slots, whatever the input."""
    size = np.zeros(slots, np.int64)
    for r in found.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        size[r.virtual_slot] = r.size
    return size


def placed(found: DataFrame, slot_map: SlotMap) -> DataFrame:
    """found with shard and slot, the row's gapless place in its shard: its number in its block, and the rows of the blocks before in that shard."""
    of = found.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(slot_map.shard)], "virtual_slot int, shard int")
    dealt = found.join(F.broadcast(of), "virtual_slot").withColumn("block", F.shiftright("row", 33))
    counted = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("shard", "block").orderBy("row")) - 1
    numbered = dealt.withColumn("own", own).join(counted.select("shard", "block", before.alias("before")), ["shard", "block"])
    return numbered.withColumn("slot", (F.col("before") + F.col("own")).cast("long")).drop("block", "own", "before", "row")


def shard(documents: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """Every document's place under a map built from the bytes per slot; the map is stored as version 1 under path and read back."""
    spark = documents.sparkSession
    found = spread(stored(records(documents), "records"))
    size = slot_weights(found)
    path = path or f"{scratch_dir(spark)}/slot-map-{spark.sparkContext.applicationId}-{abs(hash((size.tobytes(), shards)))}"
    built = SlotMap.build(size, shards)
    built.frame(spark).coalesce(1).write.mode("overwrite").partitionBy("version").parquet(path)
    return placed(found, SlotMap.load(spark, path))
