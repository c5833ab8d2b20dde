"""Sharding over fixed virtual slots.

Records are hashed into ``slots`` virtual slots, bytes are summed up for each slot, and a small
versioned table says which shard owns which slot.  The first version deals slots to shards by size
(largest first, each to the lightest shard); a later version moves slots, never single records: when a
shard is added only to that shard, when sizes drift from overfull shards to the others.  Records find their shard by joining that table, whose
size is the number of slots (a constant), so it may be broadcast.

Positions within a shard come from counts for each cell (slot and part of it, again a constant
number) and a row number inside the cell, so no task sees a whole shard.

Defined cases: a null text has size 1 and the checksum of nothing; null ids hash like any value; a very
long text is one record and may outweigh its shard's share; slots of one size are dealt by number;
repeated rows are separate records; an empty table gives an empty result with an even map; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 4096
PARTS = 16


def records(docs: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32 and the cell (virtual_slot, slot_part) of each record.

    The checksum takes part in the hash, so that different texts under one frequent id spread.
    """
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
        .withColumn("slot_part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int"))
    )


def slot_sizes(cells: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, slot_bytes for every slot, those without records too."""
    spark = cells.sparkSession
    known = cells.groupBy("virtual_slot").agg(F.sum("cell_bytes").alias("known_bytes"))
    return (
        spark.range(slots)
        .select(F.col("id").cast("int").alias("virtual_slot"))
        .join(known, "virtual_slot", "left")
        .select("virtual_slot", F.coalesce("known_bytes", F.lit(0)).cast("long").alias("slot_bytes"))
    )


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots by falling size, each to the shard that is lightest so far.

    One row holds the sorted array of all slots; their number is a constant.
    """
    ordered = sizes.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot"))).alias("slots")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.expr("cast(array() as array<int>)").alias("owners")
    )

    def deal(acc, slot):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda load, i: F.when(i == at, load - slot["less"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(acc["owners"], F.array(at)).alias("owners"))

    dealt = ordered.select("slots", F.aggregate("slots", start, deal)["owners"].alias("owners"))
    return (
        dealt.select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
        .select(
            F.lit(1).alias("version"),
            F.col("x.slots.virtual_slot").alias("virtual_slot"),
            F.col("x.owners").alias("shard"),
            (-F.col("x.slots.less")).alias("slot_bytes"),
        )
    )


def add_shard(current: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number ``shards`` added: each old shard gives its share, none else moves.

    From each shard the slots go, in hash order, whose running size stays within what the shard has
    above the new average.
    """
    total = F.sum("slot_bytes").over(W.partitionBy(F.lit(0)))
    own = F.sum("slot_bytes").over(W.partitionBy("shard"))
    running = F.sum("slot_bytes").over(W.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot"))
    spare = F.col("own") - F.col("total") / (shards + 1)
    return (
        current.withColumns({"total": total, "own": own, "running": running})
        .withColumn("shard", F.when((F.col("running") <= spare) & (F.col("slot_bytes") > 0), shards).otherwise(F.col("shard")))
        .select((F.col("version") + 1).alias("version"), "virtual_slot", F.col("shard").cast("int").alias("shard"), "slot_bytes")
    )


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version after the slots grew to ``sizes``: overfull shards give slots to those under the average.

    A shard gives slots in hash order up to what it has above the average; the slots given, laid end to
    end, fall into the gaps of the others, laid end to end.  No other slot moves.
    """
    grown = current.select("version", "virtual_slot", "shard").join(sizes, "virtual_slot")
    own = F.sum("slot_bytes").over(W.partitionBy("shard"))
    running = F.sum("slot_bytes").over(W.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot"))
    mean = F.sum("slot_bytes").over(W.partitionBy(F.lit(0))) / shards  # slots are a constant number of rows
    marked = grown.withColumns({"own": own, "running": running, "mean": mean})
    given = marked.withColumn("given", (F.col("running") <= F.col("own") - F.col("mean")) & (F.col("slot_bytes") > 0))
    order = W.partitionBy("given").orderBy("shard", F.xxhash64("virtual_slot"), "virtual_slot")
    given = given.withColumn("middle", F.sum("slot_bytes").over(order) - F.col("slot_bytes") / 2)
    loads = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("taker")).join(grown.groupBy("shard").agg(F.sum("slot_bytes").alias("load")), F.col("taker") == F.col("shard"), "left")
    gap = F.greatest(F.lit(0.0), F.col("mean") - F.coalesce("load", F.lit(0)))
    gaps = loads.join(F.broadcast(grown.agg((F.sum("slot_bytes") / shards).alias("mean")))).select("taker", gap.alias("gap")).where("gap > 0")
    until = F.sum("gap").over(W.partitionBy(F.lit(0)).orderBy("taker"))
    gaps = gaps.withColumn("until", until).select("taker", (F.col("until") - F.col("gap")).alias("since"), "until")
    # at most one row a shard
    joined = given.join(F.broadcast(gaps), F.col("given") & (F.col("middle") > F.col("since")) & (F.col("middle") <= F.col("until")), "left")
    return joined.select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("taker", "shard").cast("int").alias("shard"), "slot_bytes")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a version of the map; a version that is there already is an error, so that of two writers one fails."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version (the newest if none is named)."""
    stored = spark.read.parquet(path).select("version", "virtual_slot", "shard", "slot_bytes")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def cells_of(placed: DataFrame) -> DataFrame:
    """Bytes and records of each cell."""
    return placed.groupBy("virtual_slot", "slot_part").agg(
        F.sum("size").alias("cell_bytes"), F.count("*").alias("cell_rows")
    )


def assign(placed: DataFrame, cells: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` and ``position`` (gapless from 0 within the shard) to the records."""
    before = W.partitionBy("shard").orderBy("virtual_slot", "slot_part").rowsBetween(W.unboundedPreceding, -1)
    bases = cells.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").select(
        "virtual_slot", "slot_part", "shard", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(W.partitionBy("virtual_slot", "slot_part").orderBy("doc_id", "text_crc32", "row"))
    return (
        placed.withColumn("inside", inside)
        .join(F.broadcast(bases), ["virtual_slot", "slot_part"])  # at most slots * parts rows
        .withColumn("position", F.col("base") + F.col("inside") - 1)
        .drop("base", "inside")
    )
