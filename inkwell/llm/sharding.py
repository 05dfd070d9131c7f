"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of slots, for good. Bytes are
summed by slot, and a versioned map says which shard holds which slot.
Rebalancing edits the map: it moves or swaps a few slots between shards, never
a single record. The law is ``bytes``: the shards' sizes are near equal.

Defined results: a null text has no bytes, so a size of 16 and a CRC of 0. A
record is its id and its text's CRC, so repeated ids with other texts spread;
rows that are equal in both share a slot. Ties are ordered by id, CRC and size.
An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import exists

SLOTS, SHARDS, ROW_BYTES = 8192, 40, 16
#: Rebalancing ends when the largest shard is within this share of the mean, or no move helps.
CLOSE = 0.0005


@dataclass
class SlotMap:
    """Which shard holds each slot; every edit makes a new version."""

    shard_of: np.ndarray
    n_shards: int
    version: int = 1
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)  # version, slot, from, to

    @classmethod
    def first(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return cls(np.arange(slots) % shards, shards)

    def _move(self, slot: int, to: int) -> None:
        self.edits.append((self.version + 1, slot, int(self.shard_of[slot]), to))
        self.shard_of[slot] = to

    def rebalance(self, weight: np.ndarray, n_shards: int | None = None) -> SlotMap:
        """A new version with near equal shards: slots go from the largest shard to the smallest, or are swapped."""
        new = SlotMap(self.shard_of.copy(), n_shards or self.n_shards, self.version, list(self.edits))
        load = np.bincount(new.shard_of, weight, new.n_shards)
        mean = load.mean() if len(load) else 0
        for _ in range(20 * len(weight)):
            done = True
            most = int(load.argmax())
            if load[most] <= mean * (1 + CLOSE):
                break
            own = np.flatnonzero(new.shard_of == most)
            for least in np.argsort(load, kind="stable")[: max(1, new.n_shards // 4)]:
                gap = load[most] - load[least]
                if gap <= 0 or least == most:
                    continue
                other = np.flatnonzero(new.shard_of == least)
                # Moving d from one to the other leaves the larger of both at most as large when 0 < d < gap.
                single = np.abs(weight[own] - gap / 2)
                best, pair = int(single.argmin()), None
                cost = single[best]
                if len(other):
                    order = np.argsort(weight[other], kind="stable")
                    want = weight[own] - gap / 2
                    at = np.clip(np.searchsorted(weight[other][order], want), 0, len(other) - 1)
                    for near in (at, np.maximum(at - 1, 0)):
                        d = np.abs(weight[own] - weight[other][order][near] - gap / 2)
                        if d.min() < cost:
                            cost, pair = d.min(), (int(d.argmin()), int(order[near[int(d.argmin())]]))
                if cost >= gap / 2:
                    continue
                a = int(own[pair[0] if pair else best])
                moved = weight[a]
                new._move(a, int(least))
                if pair:
                    moved -= weight[other[pair[1]]]
                    new._move(int(other[pair[1]]), most)
                load[most] -= moved
                load[least] += moved
                done = False
                break
            if done:
                break
        new.version += 1
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, i, int(s), self.n_shards) for i, s in enumerate(self.shard_of)], "version int, virtual_slot int, shard int, n_shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the stored map."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The latest version stored, or the one asked for."""
        t = spark.read.parquet(path)
        v = t.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted((r["virtual_slot"], r["shard"], r["n_shards"]) for r in t.where(F.col("version") == v).collect())
        return cls(np.array([s for _, s, _ in rows]), rows[0][2], int(v))


def records(df: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(df: DataFrame, path: str, slots: int = SLOTS, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, map_version, shard, and slot: the row's place in its shard from 0.

    ``path`` is the folder of the versioned map, in a store that all executors
    share. The latest version there, or a first one, is rebalanced by the bytes
    of the slots and stored as a new version, by which the rows are dealt. A
    place is the number of rows in the shard's earlier slots and the row's
    number in its slot, so no task sorts a whole shard.
    """
    spark = df.sparkSession
    rows = records(df, slots, id_col, text_col)
    # As many rows as slots, a fixed number.
    sums = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    weight = np.array([sums.get(i, (0, 0))[0] for i in range(slots)], float)
    if not exists(spark, path):
        SlotMap.first(slots, shards).save(spark, path)
    SlotMap.load(spark, path).rebalance(weight, shards).save(spark, path)
    slot_map = SlotMap.load(spark, path)
    before = [0] * slot_map.n_shards
    table = []
    for i, s in enumerate(slot_map.shard_of.tolist()):
        table.append((i, s, before[s]))
        before[s] += sums.get(i, (0, 0))[1]
    places = spark.createDataFrame(table, "virtual_slot int, shard int, before long")
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("_n", within).join(F.broadcast(places), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", F.lit(slot_map.version).alias("map_version"), "shard", (F.col("before") + F.col("_n") - 1).alias("slot")
    )


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of the query, from those of ``shard``."""
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
