"""Gapless row numbers without a single-partition window, and the reading orders built on them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graincart.errors import InvalidOption
from graincart.operators.scratch import durable

_LOW = (1 << 33) - 1


def sorted_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` sorted over its partitions and kept so, with ``_part`` and ``_place`` (from 0 in the part)."""
    marked = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(marked).withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit(_LOW))}).drop("_id")


def with_row_index(df: DataFrame, order: list[Column | str], out: str = "row_index") -> DataFrame:
    """``df`` with its place from 0 in ``order``. Only one count per partition reaches the driver."""
    parts = sorted_parts(df, order)
    base, offsets = 0, []
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], base))
        base += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "_part long, _base long")
    return parts.join(F.broadcast(table), "_part").withColumn(out, F.col("_place") + F.col("_base")).drop("_part", "_place", "_base")


#: Chunks whose first record numbers are broadcast to the scan at most; more are joined by a shuffle.
BROADCAST_CHUNKS = 1_000_000


def with_record_index(spark: SparkSession, path: str, form: str = "records", **options) -> DataFrame:
    """A scan with metadata and ``record_index``, each record's place in its shard, by the counts of the chunk headers.

    Shards are read in splits; a pass over the headers alone counts the records before each chunk.
    With recovery, a record keeps the place it was written to.
    """
    read = spark.read.format(form).options(**options).option("metadata", "true").load(path)
    chunks = spark.read.format("record_chunks").options(**options).load(path).select("shard_id", "chunk_begin", "num_records")
    before = F.sum("num_records").over(Window.partitionBy("shard_id").orderBy("chunk_begin").rowsBetween(Window.unboundedPreceding, -1))
    first = durable(chunks.select("shard_id", "chunk_begin", F.coalesce(before, F.lit(0)).alias("_first")))
    if first.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS:
        first = F.broadcast(first)
    return read.join(first, ["shard_id", "chunk_begin"]).withColumn("record_index", F.col("_first") + F.col("chunk_record")).drop("_first", "chunk_record")


def admission(counts: list[int], opened: int) -> list[tuple[int, int]]:
    """(first turn, slot) of each shard where at most ``opened`` are read in turn.

    A slot gives one record in each turn. When its shard has none left, that turn passes, and the next
    shard of the list takes the slot from the following turn on.
    """
    slots = max(1, min(opened, len(counts)))
    out = [(0, s) for s in range(min(slots, len(counts)))]
    ends = [(counts[s], s) for s in range(len(out))]
    heapq.heapify(ends)
    for n in counts[len(out) :]:
        turn, slot = heapq.heappop(ends)
        out.append((turn + 1, slot))
        heapq.heappush(ends, (turn + 1 + n, slot))
    return out


def reading_order(records: DataFrame, mode: str = "drain", out: str = "position", max_concurrent_shards: int | None = None) -> DataFrame:
    """Records with shard_order and record_index, with each record's position: whole shards in turn, or one record of each shard in turn.

    ``max_concurrent_shards``: how many shards the turns go round at once (at least 1; all by default).
    The shards' record counts, one number each, are brought to the driver for it.
    """
    if mode not in ("drain", "round_robin"):
        raise InvalidOption(f"reading order must be drain or round_robin, not {mode}")
    if mode == "drain":
        return with_row_index(records, ["shard_order", "record_index"], out)
    if max_concurrent_shards is None:
        return with_row_index(records, ["record_index", "shard_order"], out)
    counts = sorted((r.shard_order, r.n) for r in records.groupBy("shard_order").agg(F.count("*").alias("n")).collect())
    places = [(k, *p) for (k, _), p in zip(counts, admission([n for _, n in counts], max_concurrent_shards), strict=True)]
    table = records.sparkSession.createDataFrame(places, "shard_order int, _turn long, _slot int")
    turned = records.join(F.broadcast(table), "shard_order").withColumn("_turn", F.col("_turn") + F.col("record_index"))
    return with_row_index(turned, ["_turn", "_slot"], out).drop("_turn", "_slot")
