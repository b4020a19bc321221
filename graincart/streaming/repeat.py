"""Random repeating reading of shards: every epoch reads each shard once, in an order drawn by the seed.

A draw is a number: draw ``n`` of ``s`` shards is place ``n mod s`` of epoch ``n div s``. Batches take
the draws of so many epochs; a stream takes them from Spark's own rate source and never ends, and
goes on where it was after a restart. The shards are listed once, when the reading is planned.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.errors import InvalidOption
from graincart.sources.records import RecordsReader, Settings, Split, Task

_SCHEMA = "epoch long, rank long, shard_id string, record_index long, value binary"


def permutation(names: list[str], seed: int, epoch: int) -> list[int]:
    """The order of an epoch: by MD5 of seed, epoch and file name, as ``operators.sharding.random_epochs`` ranks them."""
    draw = lambda k: (hashlib.md5(f"{seed}:{epoch}:{names[k]}".encode()).hexdigest(), names[k], k)
    return sorted(range(len(names)), key=draw)


def read_draws(draws: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """The records of the shards that the numbers in the long column ``draw`` stand for."""
    found = settings.found()
    names = [posixpath.basename(p) for p, _ in found]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader, orders = RecordsReader(settings), {}
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                epoch, rank = divmod(draw, len(found))
                if epoch not in orders:
                    orders = {epoch: permutation(names, seed, epoch)}
                path, size = found[orders[epoch][rank]]
                index = 0
                for part in reader.read(Task([Split(path, rank, 0, size, size)])):
                    n = part.num_rows
                    columns = [pa.array([epoch] * n, pa.int64()), pa.array([rank] * n, pa.int64()), pa.array([path] * n), pa.array(np.arange(index, index + n)), part.column(0)]
                    yield pa.RecordBatch.from_arrays(columns, ["epoch", "rank", "shard_id", "record_index", "value"])
                    index += n

    return draws.select("draw").mapInArrow(run, _SCHEMA)


def _settings(path: str | list[str], options: dict) -> Settings:
    return Settings({"shardPaths": json.dumps(path), **options} if isinstance(path, list) else {"path": path, **options})


def random_read(spark: SparkSession, path: str | list[str], epochs: int, seed: int, **options) -> DataFrame:
    """(epoch, rank, shard_id, record_index, value) of ``epochs`` passes over a folder's shards, or over a list of paths that must all exist."""
    if epochs < 1:
        raise InvalidOption("at least one epoch is needed")
    settings = _settings(path, options)
    draws = epochs * len(settings.found())
    return read_draws(spark.range(draws, numPartitions=min(draws, 10_000)).withColumnRenamed("id", "draw"), settings, seed)


def random_stream(spark: SparkSession, path: str | list[str], seed: int, shards_per_batch: int = 8, **options) -> DataFrame:
    """The same without an end, as a stream: each micro-batch reads the next ``shards_per_batch`` draws."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", shards_per_batch).option("numPartitions", shards_per_batch).load()
    return read_draws(rate.select(F.col("value").alias("draw")), _settings(path, options), seed)


