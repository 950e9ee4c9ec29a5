"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, bytes and rows are summed per slot, and a small versioned table says
which shard holds which slot. Rebalancing edits that table; no record is hashed anew. Everything is DataFrame and SQL
functions. Only the slot table (``slots`` rows, a parameter) is broadcast or brought into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.llm.common import keyed

SLOTS = 8192
SHARDS = 24


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row.

    ``size`` is the UTF-8 bytes plus 8. A NULL text counts as empty. A NULL id is placed by its text, so that such
    rows spread. Rows with equal ids share a slot.
    """
    rows = keyed(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id"))
    return rows.withColumn("virtual_slot", F.pmod(place, F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n_rows) for every slot, empty ones included; summed before the shuffle."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    return every.join(sums, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("n_rows", zero).alias("n_rows")
    )


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt round to the shards, before any byte has been seen."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: near equal bytes in ``shards`` shards, moving few slots.

    Each shard keeps its slots, in slot order, up to its fair share. The others, largest first, go one by one to the
    shard that is lightest then. A shard above the new count gives up everything; a new one starts empty.
    """
    upto = "sum(bytes) over (partition by shard order by virtual_slot)"
    marked = loads.join(slot_map, "virtual_slot").select(
        "virtual_slot", "shard", "bytes", F.expr(f"{upto} <= sum(bytes) over () / {shards} and shard < {shards}").alias("stays")
    )
    start = f"""sort_array(transform(sequence(0, {shards - 1}), s -> struct(
        aggregate(kept, 0L, (acc, k) -> acc + if(k.shard = s, k.bytes, 0L)) as load, s as shard)))"""
    deal = f"""aggregate(loose, struct(heap as heap, cast(array() as array<int>) as picks), (acc, x) -> struct(
        sort_array(concat(slice(acc.heap, 2, {max(shards - 1, 1)}), array(struct(acc.heap[0].load + x.bytes as load, acc.heap[0].shard as shard)))) as heap,
        concat(acc.picks, array(acc.heap[0].shard)) as picks))"""
    if shards == 1:
        deal = "struct(heap as heap, transform(loose, x -> 0) as picks)"
    dealt = (
        marked.groupBy()
        .agg(
            F.expr("sort_array(collect_list(if(stays, null, struct(bytes, -virtual_slot as back, virtual_slot))), false)").alias("loose"),
            F.expr("collect_list(if(stays, struct(shard, bytes), null))").alias("kept"),
        )
        .select("loose", F.expr(start).alias("heap"))
        .select("loose", F.expr(deal).alias("done"))
        .select(F.explode(F.arrays_zip(F.col("loose.virtual_slot").alias("slot"), F.col("done.picks").alias("pick"))).alias("x"))
        .select(F.col("x.slot").alias("virtual_slot"), F.col("x.pick").alias("shard"))
    )
    return marked.where("stays").select("virtual_slot", "shard").unionByName(dealt)


def save_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Write one version of the map beside the earlier ones and read it back."""
    path = f"{folder}/version={version}"
    slot_map.repartition(1).write.mode("overwrite").parquet(path)
    return slot_map.sparkSession.read.schema(slot_map.schema).parquet(path)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless another is named."""
    maps = spark.read.parquet(folder)
    wanted = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == wanted).select("virtual_slot", "shard")


def shard_rows(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard: gapless from 0, by virtual slot, then id and CRC.

    Places come from the slots' row counts and a numbering inside each virtual slot, so no task ever holds a shard.
    """
    before = F.expr("sum(n_rows) over (partition by shard order by virtual_slot) - n_rows")
    placed = slot_map.join(loads, "virtual_slot").select("virtual_slot", "shard", before.alias("before"))
    number = F.expr("row_number() over (partition by virtual_slot order by doc_id, text_crc32, size)")
    return (
        rows.withColumn("nth", number.cast("long"))
        .join(F.broadcast(placed), "virtual_slot")
        .withColumn("slot", F.col("before") + F.col("nth") - 1)
        .drop("before", "nth")
    )
