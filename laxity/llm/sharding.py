"""Sharding by fixed virtual slots; DataFrame operations only.

Records hash into a fixed number of slots. Bytes and rows are aggregated per slot, and a versioned map gives each
slot its shard: version 1 deals the slots out in turn, and rebalancing edits it, moving or exchanging single slots between
the fullest and the emptiest shard until their sizes are near equal. The law is `bytes`. The map has as many
entries as there are slots, whatever the data, so it is edited on the driver; it is stored as a table.

A record is (doc_id, size, text checksum). Equal records are counted before anything is dealt out and go out in blocks of
BLOCK copies, each block hashed by itself, so that one key with a third of all rows spreads over many slots.

Defined results: a null text has size 1 and the checksum of the empty text; a null doc_id is a value like any other; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table, work_path

SLOTS = 4096
SHARDS = 8
BLOCK = 256


@dataclass
class SlotMap:
    """Versions of the slot-to-shard map; the last one holds."""

    shards: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def first(cls, slots: int, shards: int) -> "SlotMap":
        return cls(shards, [[s % shards for s in range(slots)]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def rebalance(self, weight: list[int]) -> "SlotMap":
        """A new version: while it brings them closer, a slot of the fullest shard moves to the emptiest, or two are exchanged."""
        to, load, own = list(self.current), [0] * self.shards, [set() for _ in range(self.shards)]
        for slot, shard in enumerate(to):
            load[shard] += weight[slot]
            if weight[slot]:
                own[shard].add(slot)
        for _ in range(64 * self.shards + len(to)):
            high, low = max(range(self.shards), key=lambda s: (load[s], s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            best, what = gap, None
            for slot in sorted(own[high]):
                if (left := abs(gap - 2 * weight[slot])) < best:
                    best, what = left, (slot, None)
            if best * 200 > sum(load) / self.shards:  # a single move leaves over half a per cent: try an exchange
                small = sorted((weight[s], s) for s in own[low])
                i = 0
                for w, slot in sorted((weight[s], s) for s in own[high]):
                    while i < len(small) - 1 and 2 * (w - small[i][0]) > gap:
                        i += 1
                    for j in (i - 1, i):
                        if 0 <= j < len(small) and (left := abs(gap - 2 * (w - small[j][0]))) < best:
                            best, what = left, (slot, small[j][1])
            if what is None:
                break
            for slot, a, b in ((what[0], high, low), (what[1], low, high)):
                if slot is not None:
                    own[a].remove(slot), own[b].add(slot)
                    load[a], load[b], to[slot] = load[a] - weight[slot], load[b] + weight[slot], b
            if best * 2000 < sum(load) / self.shards and max(load) - min(load) <= best:
                break
        self.versions.append(to)
        return self

    def grow(self, weight: list[int]) -> "SlotMap":
        """A new version with one more shard, which takes slots from the fullest ones; no other slot moves."""
        to, load = list(self.current), [0] * (self.shards + 1)
        for slot, shard in enumerate(to):
            load[shard] += weight[slot]
        target = sum(load) / len(load)
        for slot in sorted(range(len(to)), key=lambda s: (-weight[s], s)):
            if load[to[slot]] - weight[slot] >= target and load[-1] + weight[slot] <= target:
                load[to[slot]] -= weight[slot]
                load[-1] += weight[slot]
                to[slot] = self.shards
        self.shards += 1
        self.versions.append(to)
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard."""
        rows = F.array(*[F.struct(F.lit(v + 1).alias("version"), F.expr(f"array({','.join(map(str, m))})").alias("to")) for v, m in enumerate(self.versions)])
        each = spark.range(1).select(F.explode(rows).alias("v"))
        return each.select(F.col("v.version").alias("version"), F.posexplode("v.to").alias("slot", "shard"))

    def write(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "SlotMap":
        """The map is as large as the number of slots and versions, not as the data."""
        versions: dict[int, dict[int, int]] = {}
        for version, slot, shard in spark.read.parquet(path).select("version", "slot", "shard").toLocalIterator():
            versions.setdefault(version, {})[slot] = shard
        found = [[m[s] for s in sorted(m)] for _, m in sorted(versions.items())]
        return cls(max(found[-1]) + 1, found)


def _looked_up(values: list[int], index: Column, kind: str) -> Column:
    return F.element_at(F.expr(f"cast(array({','.join(map(str, values))}) as array<{kind}>)"), index + 1)


def records(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, size, text_crc32, block, copies, vslot: a row for each block of equal records."""
    text = F.coalesce("text", F.lit(""))
    rec = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rec = rec.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rec = rec.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    rec = rec.withColumn("copies", F.least(F.lit(BLOCK).cast("long"), F.col("n") - F.col("block") * BLOCK)).drop("n")
    return rec.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "block"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard, vslot, map_version."""
    spark = docs.sparkSession
    rec = stored(records(docs, slots), "records")
    weight, rows = [0] * slots, [0] * slots
    sums = rec.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    for r in sums.collect():  # at most `slots` rows
        weight[r["vslot"]], rows[r["vslot"]] = r["bytes"], r["rows"]
    found = SlotMap.first(slots, shards).rebalance(weight)
    found.write(spark, path := path or work_path(spark, "slotmap"))
    to, base, start = SlotMap.read(spark, path).current, [0] * shards, []
    for slot in range(slots):
        start.append(base[to[slot]])
        base[to[slot]] += rows[slot]
    own = W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "block")
    rec = rec.withColumn("before", F.sum("copies").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("copies"))
    rec = rec.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return rec.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _looked_up(to, F.col("vslot"), "int").alias("shard"),
        (_looked_up(start, F.col("vslot"), "bigint") + F.col("before") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(len(found.versions)).alias("map_version"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
