"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

A record's identity (doc_id and text) hashes to one of a fixed number of slots. Spark
sums the bytes of each slot; the map from slots to shards is an edit of the last
version that moves as few slots as make shard sizes near equal. Records never move
between slots, so rebalancing moves whole slots. The map has every slot, also those without rows, and no version is ever
overwritten. Everything is built from DataFrame
functions; the driver sees one row for each slot, never one for each record.

Rows that are equal in doc_id and text are numbered, and all but the first hash with their number, so that a row
repeated any number of times spreads over the slots, and over the same ones in each run.

Defined cases: a null text counts as empty; a null doc_id hashes as such; equal rows are told apart by their number
only, in no defined order; a text of any length is one record, which no slot can split; an empty table gives an empty result and a map
of empty slots; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, numbered, scratch, small_table, table

SLOTS = 4096


def slot_of(slots: int, identity: Column, copy: Column) -> Column:
    """The slot of a copy of a record; the first copy's follows from its identity alone."""
    return F.pmod(F.when(copy == 0, identity).otherwise(F.xxhash64(identity, copy)), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each document; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), text).alias("identity"),
        F.monotonically_increasing_id().alias("place"),
    )
    given = materialize(given, "records")
    repeats = materialize(given.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    keys, total = repeats.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    copies = numbered(given, "identity", repeats, keys, total).withColumnRenamed("idx", "copy")
    single = given.join(repeats, "identity", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    slotted = single.unionByName(copies).withColumn("virtual_slot", slot_of(slots, F.col("identity"), F.col("copy")))
    return materialize(slotted.select("doc_id", "size", "text_crc32", "virtual_slot", "place"), "slotted")


def slot_totals(recs: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot."""
    got = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(range(slots), (0, 0)) | {r["virtual_slot"]: (r["b"], r["n"]) for r in got}


def edit_map(totals: dict[int, tuple[int, int]], shards: int, last: dict[int, int] | None = None, tolerance: float = 0.001) -> dict[int, int]:
    """The next version of the map: slot -> shard.

    Without a last version, slots go largest first to the lightest shard. With one, slots stay
    where they are unless their shard is gone or new; then slots leave the heaviest shard
    for the lightest while that narrows the gap by more than the tolerance.
    """
    size = {s: b for s, (b, _) in totals.items()}
    placed = {s: h for s, h in (last or {}).items() if h < shards and s in size}
    load = [0] * shards
    for s, h in placed.items():
        load[h] += size[s]
    heap = [(load[h], h) for h in range(shards)]
    heapq.heapify(heap)
    for s in sorted(size.keys() - placed.keys(), key=lambda s: (-size[s], s)):
        if not size[s]:  # empty slots, which come last, are dealt in turn
            placed[s] = s % shards
            continue
        now, h = heapq.heappop(heap)
        placed[s] = h
        heapq.heappush(heap, (now + size[s], h))
        load[h] = now + size[s]
    fair = sum(size.values()) / shards
    for _ in range(4 * len(size)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap <= tolerance * fair:
            break
        movable = [s for s, h in placed.items() if h == high and 0 < size[s] < gap]
        if not movable:
            break
        s = min(movable, key=lambda s: (abs(gap / 2 - size[s]), s))
        placed[s] = low
        load[high] -= size[s]
        load[low] += size[s]
    return placed


def store_map(spark: SparkSession, folder: str, version: int, mapping: dict[int, int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Writes a new version of the map as a table and returns it with each slot's first place in its shard.

    A version that exists is an error: readers hold on to it.
    """
    base: dict[int, int] = {}
    rows = []
    for s in sorted(mapping):
        h = mapping[s]
        rows.append({"virtual_slot": s, "shard": h, "first": base.get(h, 0), "bytes": totals[s][0]})
        base[h] = base.get(h, 0) + totals[s][1]
    out = small_table(spark, rows, "virtual_slot int, shard int, first bigint, bytes bigint")
    out.write.mode("error").parquet(f"{folder}/version={version}")
    return spark.read.schema(out.schema).parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r["virtual_slot"]: r["shard"] for r in spark.read.parquet(f"{folder}/version={version}").collect()}


def shard(docs: DataFrame, shards: int, folder: str, slots: int = SLOTS, version: int = 1, last_version: int | None = None) -> DataFrame:
    """Every document with its shard and its gapless place there.

    The map is broadcast: it has ``slots`` rows whatever the input.
    """
    spark = docs.sparkSession
    recs = records(docs, slots)
    totals = slot_totals(recs, slots)
    last = load_map(spark, folder, last_version) if last_version is not None else None
    stored = store_map(spark, folder, version, edit_map(totals, shards, last), totals)
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "place"))
    placed = recs.withColumn("within", place.cast("long") - 1).join(F.broadcast(stored.select("virtual_slot", "shard", "first")), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).alias("slot"), "virtual_slot")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under law ``bytes``."""
    out = shard(table(spark, sf_dir, "documents"), 8, scratch(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
