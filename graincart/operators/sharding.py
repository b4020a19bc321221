"""Sharded writing, appending, in-memory shards, and shard permutations over epochs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.errors import InvalidOption
from graincart.functions.encoding import BLOCK
from graincart.operators.ordering import with_row_index
from graincart.sources import layout
from graincart.sources.records import filesystem, register


def round_robin(df: DataFrame, shards: int, order: list[Column | str], out: str = "shard") -> DataFrame:
    """``df`` with its shard: row i in ``order`` goes to shard i mod ``shards``; and ``row_index``."""
    if shards < 1:
        raise InvalidOption("at least one shard is needed")
    return with_row_index(df, order).withColumn(out, F.pmod("row_index", F.lit(shards)).cast("int"))


def write_round_robin(df: DataFrame, path: str, shards: int, order: list[Column | str], **options) -> None:
    """``value`` of ``df`` written to ``shards`` files, each in ``order``."""
    register(df.sparkSession)
    dealt = round_robin(df, shards, order).repartitionById(shards, F.col("shard")).sortWithinPartitions("row_index")
    dealt.select("value").write.format("records").options(**options).mode("append").save(path)


def append_in_place(df: DataFrame, path: str, order: list[Column | str], block: int = BLOCK, **settings) -> None:
    """``value`` of ``df`` appended to one existing file.

    One task writes the tail to a side file, which is then added to the file in blocks: a task that
    is repeated appends nothing twice.
    """
    system, name = filesystem(path)
    begin = system.get_file_info(name).size

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        side = f"{name}.tail-{TaskContext.get().taskAttemptId()}"
        there, _ = filesystem(path)
        with there.open_output_stream(side) as file:
            writer = layout.FileWriter(file, block, at=begin, **settings)
            for batch in batches:
                column = batch.column(0).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                writer.write_values(offsets, memoryview(column.buffers()[2] or b""))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([side])], ["side"])

    side = df.orderBy(*order).select("value").coalesce(1).mapInArrow(write, "side string").collect()[0][0]
    with system.open_input_stream(side) as tail, system.open_append_stream(name) as file:
        while part := tail.read(8 << 20):
            file.write(part)
    system.delete_file(side)


def decode_shards(contents: DataFrame, name_col: str = "path", content_col: str = "content", block: int = BLOCK, recover: bool = False) -> DataFrame:
    """(shard_id, record_index, value) of files held as binary rows, such as ``binaryFile`` gives."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = 0
                for found in layout.read_records(layout.BytesSource(content), 0, None, block, recover):
                    if isinstance(found, layout.Skip):
                        continue
                    _, offsets, values = found
                    n = len(offsets) - 1
                    rows = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(index, index + n)), rows], ["shard_id", "record_index", "value"])
                    index += n

    return contents.select(name_col, content_col).mapInArrow(run, "shard_id string, record_index long, value binary")


def random_epochs(shards: DataFrame, epochs: int, seed: int, name_col: str = "shard_id") -> DataFrame:
    """(epoch, rank, shard) of ``epochs`` passes: each a permutation of the distinct shards, fixed by the seed."""
    if epochs < 1:
        raise InvalidOption("at least one epoch is needed")
    each = shards.select(name_col).distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "epoch", name_col))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("epoch").orderBy(draw, name_col)) - 1).select("epoch", "rank", name_col)
