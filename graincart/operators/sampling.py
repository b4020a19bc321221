"""Weighted interleaving of sources without replacement, and bounded reservoir shuffling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.errors import InvalidOption
from graincart.operators.ordering import sorted_parts


def _uniform(seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "source", "pos")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _weight(weights: dict[str, float], default: float | None) -> Column:
    if not weights and default is None:
        raise InvalidOption("no sources")
    if bad := [s for s, w in {**weights, "default": 1.0 if default is None else default}.items() if not w > 0]:
        raise InvalidOption(f"the weight of {bad[0]} must be above zero")
    other = F.raise_error(F.concat(F.lit("no weight for the source "), F.coalesce("source", F.lit("null")))).cast("double") if default is None else F.lit(float(default))
    if not weights:
        return other
    return F.coalesce(F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))])[F.col("source")], other)


def sources(records: DataFrame, weights: dict[str, float], default: float | None = None) -> DataFrame:
    """(source, weight, records) of the sources that have records: what an interleaving draws from at its start."""
    return records.groupBy("source").agg(F.count("*").alias("records")).select("source", _weight(weights, default).alias("weight"), "records")


def weighted_interleave(records: DataFrame, weights: dict[str, float], seed: int, default: float | None = None) -> DataFrame:
    """``records`` (source, pos, and any others) with ``arrival``: sorted by it, sources interleave by weight.

    An exponential race: record k of a source arrives at the sum of its first k gaps, each an
    exponential with the source's weight as rate. At every step the next record comes from a source
    with probability of its weight over the weights of all sources that still have records, and a
    source keeps its order. Sums run inside sorted partitions; one total per source and partition is
    added from a table of that size, so no source is gathered in one task. An arrival is the sum of
    its gaps rounded once, however the rows are partitioned. A source without a weight has the weight
    ``default``; without that the job fails.
    """
    weight = _weight(weights, default)
    # a gap is a multiple of a power of two, whose sums are exact up to 2**53 of it, and a small rest: order and parts of the sums do not change them
    least = min([*weights.values(), *([] if default is None else [default])])
    unit = 2.0 ** (math.ceil(-math.log2(min(max(least, 1e-280), 1e280))) - 20)
    high = F.floor(F.col("_gap") / unit).cast("double") * unit
    parts = records.withColumn("_gap", -F.log(_uniform(seed)) / weight).withColumn("_high", high).withColumn("_low", F.col("_gap") - F.col("_high")).drop("_gap")
    gaps = sorted_parts(parts, ["source", "pos"])
    totals = gaps.groupBy("source", "_part").agg(F.sum("_high").alias("_highs"), F.sum("_low").alias("_lows"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("_highs", "_lows")))
    inside = Window.partitionBy("source", "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    arrival = (F.col("_highs") + F.sum("_high").over(inside)) + (F.col("_lows") + F.sum("_low").over(inside))
    return gaps.join(F.broadcast(base), ["source", "_part"]).withColumn("arrival", arrival).drop("_high", "_low", "_part", "_place", "_highs", "_lows")


def reservoir_order(inputs: int, buffer: int, rng: np.random.Generator, slots: np.ndarray, next_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids that leave as ``inputs`` more arrive, numbered from ``next_id``; the slots' ids afterwards)."""
    fill = min(inputs, buffer - len(slots))
    slots = np.r_[slots, np.arange(next_id, next_id + fill)]
    new = np.arange(next_id + fill, next_id + inputs)
    drawn = rng.integers(buffer, size=len(new))
    # who leaves a slot is who came to it last before: the arrival before in order of slot and time, or its occupant
    order = np.argsort(drawn, kind="stable")
    at = drawn[order]
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.empty(0, bool)
    out = np.empty(len(new), np.int64)
    out[order] = np.where(first, slots[at], np.r_[new[:1], new[order][:-1]] if len(new) else new)
    slots[drawn] = new  # of several arrivals the last stays
    return out, slots


def reservoir_shuffle(df: DataFrame, buffer: int, seed: int, out: str | None = None) -> DataFrame:
    """Each partition's rows, in their order, through a buffer of ``buffer`` rows.

    A full buffer gives a random row for each that arrives; what is left at the end leaves in random
    order. ``out`` names a column for the place in the partition's output. Memory is bounded by the
    buffer and one batch.
    """
    if buffer < 1:
        raise InvalidOption("the buffer must hold at least one row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + (f", `{out}` long" if out else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        store: list[pa.RecordBatch] = []  # rows that may still be in a slot; ids are places in it
        slots, size, given = np.empty(0, np.int64), 0, 0

        def emit(picks):
            nonlocal given
            part = pa.Table.from_batches(store).take(pa.array(picks))
            if out:
                part = part.append_column(out, pa.array(np.arange(given, given + len(picks))))
            given += len(picks)
            yield from part.combine_chunks().to_batches()

        for batch in batches:
            store.append(batch)
            picks, slots = reservoir_order(batch.num_rows, buffer, rng, slots, size)
            size += batch.num_rows
            if len(picks):
                yield from emit(picks)
            if size > 4 * (len(slots) + batch.num_rows):  # most of the store has left
                store = pa.Table.from_batches(store).take(pa.array(slots)).combine_chunks().to_batches()
                slots, size = np.arange(len(slots)), len(slots)
        if size:
            yield from emit(rng.permutation(slots))

    return df.mapInArrow(run, schema)
