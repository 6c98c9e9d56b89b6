"""Operator 10, sharding: fixed virtual slots and a versioned slot-to-shard map.

Each record is hashed into one of SLOTS slots. The bytes of each slot are summed (SLOTS rows, whatever the input), slots are
given to shards largest first, and the map is kept with a version. Rebalancing edits the map: it moves as few bytes as it can
and leaves every other slot where it was, so only records of moved slots change place.

Nulls and edges: a null text has no bytes (size 1) and the crc32 of the empty text; a null doc_id is dealt by its text alone;
repeated rows share a slot and get places of their own, but over EQUAL equal rows are numbered and dealt to the slots in turn, so
that they fill no slot, shard or task, and each slot gets as many whatever the partitions; an empty table gives an empty result.
Rows are equal in doc_id and text. Equal texts of different ids are records of their own and lie in shards of their own: the law
promises near-equal bytes alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import small, written

SLOTS = 8192
#: A slot is cut into parts of about so many rows before its rows are numbered, so that no task sorts a whole slot of any size.
PART_ROWS = 100_000
#: Equal rows from which on they are dealt one by one, and parts that each such group is numbered in.
EQUAL, PARTS = 1000, 1024
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def record_hash() -> Column:
    return F.xxhash64(F.lit("shard"), "doc_id", F.coalesce(F.col("text"), F.lit("")))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, hash and virtual slot of each record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_hash().alias("hash")).withColumn("vslot", F.pmod("hash", F.lit(slots)).cast("int"))


def spread(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """recs, written; rows that are one of over EQUAL equal ones are numbered from 0 and go to the slots in turn, each with a hash of its own.

    They are numbered in parts, after the counts of the parts before: which row gets which number depends on the partitions,
    but as the rows are equal and the numbers are the same, the slots' counts do not.
    """
    recs = written(recs, "shard-records")
    many = recs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EQUAL).select(F.col("hash").alias("of"))
    if not many.limit(1).count():
        return recs
    both = recs.join(small(many), F.col("hash") == F.col("of"), "left")
    hot = written(both.filter("of is not null").drop("of").withColumn("batch", (F.monotonically_increasing_id() % PARTS).cast("int")), "shard-equal")
    before = Window.partitionBy("hash").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy("hash", "batch").agg(F.count(F.lit(1)).alias("n")).select("hash", "batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    hot = hot.withColumn("rank", F.row_number().over(Window.partitionBy("hash", "batch").orderBy("size")) - 1)
    hot = hot.join(counts, ["hash", "batch"]).withColumn("number", F.col("offset") + F.col("rank"))
    turn = F.pmod(F.pmod("hash", F.lit(slots)) + F.col("number"), F.lit(slots)).cast("int")
    hot = hot.select("doc_id", "size", "text_crc32", F.xxhash64("hash", "number").alias("hash"), turn.alias("vslot"))
    return written(both.filter("of is null").select(*hot.columns).union(hot), "shard-records")


def slot_bytes(recs: DataFrame) -> list[tuple[int, int]]:
    """(virtual slot, bytes): at most SLOTS pairs, so they fit the driver at any input."""
    return sorted((r.vslot, r.bytes) for r in recs.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect())


def first_map(weights: list[tuple[int, int]], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Version 1: slots by falling bytes, each to the shard that has least so far; unused slots follow in turn."""
    held, weights = [(0, s) for s in range(shards)], dict(weights)
    out = []
    for vslot in sorted(range(slots), key=lambda v: (-weights.get(v, 0), v)):
        if not (w := weights.get(vslot, 0)):
            out.append((1, vslot, vslot % shards, 0))
            continue
        got, s = heapq.heappop(held)
        out.append((1, vslot, s, w))
        heapq.heappush(held, (got + w, s))
    return sorted(out)


def rebalanced(old: list[tuple[int, int, int, int]], weights: list[tuple[int, int]], shards: int, slack: float = 0.01) -> list[tuple[int, int, int, int]]:
    """The next version of a map under new weights and, it may be, another number of shards.

    Slots of shards that are gone move first; then, while a shard is over the mean by more than slack, its largest slot
    that the emptiest shard can take without passing the mean goes there. All other slots stay.
    """
    weights = dict(weights)
    at = {v: s for _, v, s, _ in old}
    held = [0] * shards
    for v, s in at.items():
        if s < shards:
            held[s] += weights.get(v, 0)
    for v in sorted((v for v, s in at.items() if s >= shards), key=lambda v: (-weights.get(v, 0), v)):
        at[v] = min(range(shards), key=lambda s: (held[s], s))
        held[at[v]] += weights.get(v, 0)
    mean = sum(held) / shards
    while True:
        high, low = max(range(shards), key=lambda s: (held[s], -s)), min(range(shards), key=lambda s: (held[s], s))
        fits = [v for v, s in at.items() if s == high and 0 < weights.get(v, 0) < held[high] - held[low] and held[low] + weights[v] <= mean * (1 + slack)]
        if held[high] <= mean * (1 + slack) or not fits:
            return sorted((old[0][0] + 1, v, s, weights.get(v, 0)) for v, s in at.items())
        best = max(fits, key=lambda v: (weights[v], -v))
        at[best] = low
        held[high] -= weights[best]
        held[low] += weights[best]


def save_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Stores one version of a map, a folder of its own. A version that is there already is an error: maps are never rewritten."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/map-{rows[0][0]:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map-{version:06d}")


def place(recs: DataFrame, slot_map: DataFrame, parts: int) -> DataFrame:
    """shard and slot (the place in its shard, gapless from 0) of each record.

    Records are numbered within (virtual slot, part); the counts before each part, SLOTS x parts rows dealt by shard,
    give the offset. Identical records are interchangeable, so any order among them gives the same table.
    """
    recs = recs.withColumn("part", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(parts)).cast("int")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    inside = Window.partitionBy("vslot", "part").orderBy("hash", "doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = recs.groupBy("shard", "vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return recs.withColumn("rank", F.row_number().over(inside)).join(offsets, ["vslot", "part"]).withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row a record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null, as the law is `bytes`), virtual slot.

    With map_path, the map is kept there as version 1.
    """
    recs = spread(records(docs, slots), slots)
    weights = slot_bytes(recs)
    rows = first_map(weights, shards, slots)
    if map_path:
        save_map(docs.sparkSession, rows, map_path)
    parts = 1 + recs.count() // (slots * PART_ROWS)
    placed = place(recs, docs.sparkSession.createDataFrame(rows, MAP_SCHEMA), parts)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
