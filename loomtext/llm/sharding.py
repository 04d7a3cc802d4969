"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a small
versioned map says which shard holds each slot.  Rebalancing edits the map: it moves as
few slots as it can, and records follow their slot.  The map has one row for each slot and
version, so it and everything done on the driver are bounded by ``SLOTS``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, materialise

#: They are never changed for a data set once its map is stored.
SLOTS, SEED = 16_384, 20_011
#: Parts of a slot that are sorted on their own.
LANES = 8
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes bigint"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a record key; null keys share the slot of the empty text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(SEED)), F.lit(slots)).cast("int")


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn, whatever they hold."""
    return [slot % shards for slot in range(slots)]


def rebalance(current: list[int], held: dict[int, int], shards: int) -> list[int]:
    """An edited map with near equal bytes on ``shards`` shards, for maps of fewer or as many shards.

    Slots leave shards above the mean, largest first as long as the shard stays at or
    above it, and then fill the least loaded shards, largest first.  Slots of shards that
    hold no more than the mean stay where they are.
    """
    load = [0] * shards
    by_shard: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(current):
        load[shard] += held.get(slot, 0)
        by_shard[shard].append((held.get(slot, 0), slot))
    mean, out, moving = sum(load) / shards, list(current), []
    for shard in range(shards):
        for size, slot in sorted(by_shard[shard], reverse=True):
            if size and load[shard] - size >= mean:
                load[shard] -= size
                moving.append((size, slot))
        small = sorted(x for x in by_shard[shard] if x[0] and x not in moving) if load[shard] > mean else []
        for size, slot in small:  # a little below the mean, so that the last places fit
            if load[shard] <= mean:
                break
            load[shard] -= size
            moving.append((size, slot))
    free = [(load[s], s) for s in range(shards)]
    heapq.heapify(free)
    for size, slot in sorted(moving, reverse=True):
        least, shard = heapq.heappop(free)
        out[slot] = shard
        heapq.heappush(free, (least + size, shard))
    return out


def settle(current: list[int], held: dict[int, int], shards: int, rounds: int = 12) -> list[int]:
    """Rebalances until the spread between the fullest and the emptiest shard no longer shrinks."""
    def spread(shard_of: list[int]) -> int:
        load = [0] * shards
        for slot, shard in enumerate(shard_of):
            load[shard] += held.get(slot, 0)
        return max(load) - min(load)

    for _ in range(rounds):
        edited = rebalance(current, held, shards)
        if spread(edited) >= spread(current):
            break
        current = edited
    return current


def store_version(spark: SparkSession, path: str, version: int, shard_of: list[int], held: dict[int, int]) -> None:
    """Appends one version to a stored map: a row for each slot, with the bytes it held when it was placed."""
    rows = [(version, slot, shard, held.get(slot, 0)) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest unless named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version").alias("v")).first()["v"]
    return table.where(F.col("version") == version)


def rebalance_stored(spark: SparkSession, path: str, held: dict[int, int], shards: int) -> tuple[int, list[int]]:
    """Loads the latest version of a stored map, edits it for the bytes that slots hold now and appends the next one.

    Returns the version in force and its shards by slot.  Nothing is written if no slot moves.
    """
    rows = load_map(spark, path).select("version", "slot", "shard").collect()  # SLOTS rows
    version, current = rows[0]["version"], [0] * len(rows)
    for r in rows:
        current[r["slot"]] = r["shard"]
    edited = settle(current, held, shards)
    if edited != current:
        version += 1
        store_version(spark, path, version, edited, held)
    return version, edited


def shard_documents(df: DataFrame, shards: int = 16, slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> tuple[DataFrame, str]:
    """Deals documents to shards of near equal bytes; returns the rows and the path of the stored map.

    A map that is stored at ``path`` is loaded, edited and stored as its next version; else
    version 0 deals the slots out in turn, and its edit is version 1.

    Adds ``size`` (UTF-8 bytes of the text and 1; null: 1), ``text_crc32`` (null text: of
    no bytes), ``virtual_slot``, ``shard`` and ``slot``, the place of the row in its shard,
    without gaps from 0: rows of a shard lie in the order of virtual slot, lane and key.
    Lanes deal the rows of a slot out evenly, also those of one key, so that no task sorts
    a whole slot where a key is common.  Repeated rows and rows of a null key are placed
    one by one, all in one slot.  An empty table gives no rows.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), slot_of(F.col(key), slots).alias("virtual_slot"))
    rows = materialise(rows.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int")), "slot-rows")  # a row's lane is settled with it
    found = rows.groupBy("virtual_slot", "_lane").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toArrow()  # SLOTS * LANES rows at most
    at = found.column("virtual_slot").to_numpy().astype(np.int64) * LANES + found.column("_lane").to_numpy()
    counts, sizes = np.zeros(slots * LANES, np.int64), np.zeros(slots * LANES, np.int64)
    counts[at], sizes[at] = found.column("n").to_numpy(), found.column("bytes").to_numpy()
    held = {int(s): int(b) for s, b in enumerate(sizes.reshape(slots, LANES).sum(1)) if b}
    if path is None:
        path = fresh_path(spark, "slot-map")
        store_version(spark, path, 0, initial_map(shards, slots), held)
    _, shard_of = rebalance_stored(spark, path, held, shards)
    owner = np.array(shard_of, np.int64)
    order = np.argsort(owner, kind="stable")  # slots by shard, then by number
    by_slot = counts.reshape(slots, LANES)[order].ravel()
    before = np.cumsum(by_slot) - by_slot
    first = np.r_[True, owner[order][1:] != owner[order][:-1]]
    starts = before[np.flatnonzero(first) * LANES]
    before -= np.repeat(np.repeat(starts, np.diff(np.r_[np.flatnonzero(first), slots])), LANES)
    kept = by_slot > 0
    table = pa.table({"virtual_slot": pa.array(np.repeat(order, LANES)[kept].astype(np.int32)), "_lane": pa.array(np.tile(np.arange(LANES, dtype=np.int32), slots)[kept]), "shard": pa.array(np.repeat(owner[order], LANES)[kept].astype(np.int32)), "_before": pa.array(before[kept])})
    places = spark.createDataFrame(table)
    within = Window.partitionBy("virtual_slot", "_lane").orderBy(F.col(key), F.col("size"), F.col("text_crc32"))
    placed = rows.withColumn("_n", F.row_number().over(within)).join(F.broadcast(places), ["virtual_slot", "_lane"])  # SLOTS * LANES rows at most
    return placed.withColumn("slot", F.col("_before") + F.col("_n") - 1).select(key, "size", "text_crc32", "virtual_slot", "shard", "slot"), path
