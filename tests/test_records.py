"""The data sources and operators on Spark."""

import hashlib
import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincart.errors import InvalidOption, NoShards
from graincart.operators.ordering import admission, reading_order, with_record_index, with_row_index
from graincart.operators.sampling import reservoir_order, reservoir_shuffle, sources, weighted_interleave
from graincart.operators.sharding import random_epochs, write_round_robin
from graincart.sources.records import RecordsStream, Settings, custom, register, shards
from graincart.streaming.repeat import random_read, random_stream


def values(spark, texts):
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "i long, value binary")


def scan(spark, path, **options):
    register(spark)
    return spark.read.format("records").options(**options).load(str(path))


def test_interleave_sums_do_not_depend_on_the_parts(spark):
    """An arrival is its gaps' sum rounded once: two units in the last place for that and for the logarithms."""
    weights = {"a": 0.25, "b": 3.0}
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("id").alias("pos"))
    got = weighted_interleave(df, weights, 5).orderBy("source", "pos").toPandas()
    for source, rows in got.groupby("source"):
        draws = (int(hashlib.md5(f"5:{source}:{pos}".encode()).hexdigest()[:13], 16) for pos in rows["pos"])
        want = np.cumsum([np.longdouble(-math.log((d + 0.5) / 2**52) / weights[source]) for d in draws])
        assert (np.abs(rows["arrival"].to_numpy() - want) <= 2 * np.spacing(want.astype(float))).all()


def test_round_robin_orders(spark, tmp_path):
    texts = [f"r{i:02}" for i in range(11)]
    write_round_robin(values(spark, texts), str(tmp_path / "d"), 3, ["i"])
    read = with_record_index(spark, str(tmp_path / "d"))
    drain = [bytes(r.value).decode() for r in reading_order(read).orderBy("position").collect()]
    assert drain == texts[0::3] + texts[1::3] + texts[2::3]
    assert [bytes(r.value).decode() for r in reading_order(read, "round_robin").orderBy("position").collect()] == texts
    with pytest.raises(InvalidOption):
        reading_order(read, "other")


def test_append_overwrite_and_names(spark, tmp_path):
    path, df = str(tmp_path / "d"), values(spark, ["a", "b"]).select("value").coalesce(1)
    register(spark)
    for _ in range(2):
        df.write.format("records").option("prefix", "part").option("startIndex", "5").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["part_5", "part_6"]
    assert scan(spark, path, prefix="part").count() == 4
    df.write.format("records").option("prefix", "part").mode("overwrite").save(path)
    assert os.listdir(path) == ["part_0"]


def test_empty_write_and_no_shards(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "d")
    values(spark, []).select("value").write.format("records").mode("append").save(path)
    assert scan(spark, path).count() == 0
    with pytest.raises(Exception, match="no shards"):
        scan(spark, tmp_path / "none").count()
    with pytest.raises(Exception, match="corruption"):
        scan(spark, path, corruption="other").count()


def test_full_writer_without_auto_shard(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="autoShard"):
        values(spark, ["x" * 10] * 3).select("value").coalesce(1).write.format("records").options(maxBytesPerShard="10", autoShard="false").mode("append").save(str(tmp_path / "d"))


def test_shard_error_names_the_shard(spark, tmp_path):
    (tmp_path / "shard_0").write_bytes(b"not a record file" * 10)
    with pytest.raises(Exception, match="shard_0"):
        scan(spark, tmp_path).count()


def test_explicit_paths_keep_their_order(spark, tmp_path):
    register(spark)
    for k in range(2):
        values(spark, [f"v{k}"]).select("value").coalesce(1).write.format("records").mode("append").save(str(tmp_path / "d"))
    import json

    paths = [str(tmp_path / "d" / f"shard_{k}") for k in (1, 0)]
    found = scan(spark, tmp_path, shardPaths=json.dumps(paths), metadata="true").orderBy("shard_order").collect()
    assert [bytes(r.value) for r in found] == [b"v1", b"v0"]


def test_metadata_in_splits(spark, tmp_path):
    texts = [f"r{i:04}" for i in range(3000)]
    write_round_robin(values(spark, texts), str(tmp_path / "d"), 2, ["i"], chunkSize="200", blockSize="4096")
    read = scan(spark, tmp_path / "d", metadata="true", blockSize="4096", splitBytes="4096")
    assert read.rdd.getNumPartitions() >= 6
    found = with_record_index(spark, str(tmp_path / "d"), blockSize="4096", splitBytes="4096").collect()
    assert sorted((r.shard_order, r.record_index, bytes(r.value).decode()) for r in found) == [(s, k, t) for s in range(2) for k, t in enumerate(texts[s::2])]


def by_queue(counts, opened):
    """Reading in turn by its definition: a queue of open shards; who has no record left makes room for the next at its end."""
    waiting, out = list(enumerate(counts)), []
    queue = [waiting.pop(0) for _ in range(max(1, min(opened, len(counts))))]
    at = [0] * len(counts)
    while queue:
        k, n = queue.pop(0)
        if at[k] < n:
            out.append((k, at[k]))
            at[k] += 1
            queue.append((k, n))
        elif waiting:
            queue.append(waiting.pop(0))
    return out


def test_admission_against_a_queue():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts, opened = rng.integers(0, 6, int(rng.integers(1, 9))).tolist(), int(rng.integers(0, 10))
        places = admission(counts, opened)
        order = sorted((turn + k, slot, shard, k) for shard, (turn, slot) in enumerate(places) for k in range(counts[shard]))
        assert [(s, k) for _, _, s, k in order] == by_queue(counts, opened)


def test_random_reading(spark, tmp_path):
    texts = [f"r{i:02}" for i in range(20)]
    write_round_robin(values(spark, texts), str(tmp_path / "d"), 5, ["i"])
    rows = random_read(spark, str(tmp_path / "d"), 4, 3).collect()
    order = {(r.epoch, r.rank): r.shard_id for r in rows}
    assert len(rows) == 80 and all(sorted(order[e, k] for k in range(5)) == sorted(set(order.values())) for e in range(4))
    assert len({tuple(order[e, k] for k in range(5)) for e in range(4)}) > 1
    again = {(r.epoch, r.rank): r.shard_id for r in random_read(spark, str(tmp_path / "d"), 4, 3).collect()}
    other = {(r.epoch, r.rank): r.shard_id for r in random_read(spark, str(tmp_path / "d"), 4, 4).collect()}
    assert again == order != other
    paths = [str(tmp_path / "d" / f"shard_{k}") for k in (3, 1)]
    assert {r.shard_id for r in random_read(spark, paths, 2, 1).collect()} == set(paths)
    with pytest.raises(NoShards):
        random_read(spark, [*paths, str(tmp_path / "missing")], 1, 1)
    with pytest.raises(InvalidOption):
        random_read(spark, paths, 0, 1)


def test_endless_random_reading(spark, tmp_path):
    write_round_robin(values(spark, [f"r{i:02}" for i in range(20)]), str(tmp_path / "d"), 5, ["i"])
    seen = []
    for _ in range(2):  # started again, it goes on
        stream = random_stream(spark, str(tmp_path / "d"), 3, shards_per_batch=4).writeStream.foreachBatch(lambda df, _: seen.extend((r.epoch, r.rank, r.shard_id) for r in df.select("epoch", "rank", "shard_id").distinct().collect()))
        stream = stream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        begin = len(seen)
        for _ in range(600):
            if len(seen) >= begin + 12:
                break
            time.sleep(0.1)
        stream.stop()
    draws = [5 * e + k for e, k, _ in seen]
    assert sorted(set(draws)) == list(range(max(draws) + 1)) and max(draws) >= 20
    batch = {(r.epoch, r.rank, r.shard_id) for r in random_read(spark, str(tmp_path / "d"), max(draws) // 5 + 1, 3).select("epoch", "rank", "shard_id").collect()}
    assert set(seen) <= batch


def test_stream_takes_shards_of_any_number_once(spark, tmp_path):
    register(spark)
    path, out = str(tmp_path / "d"), str(tmp_path / "out")

    def add(text, start):
        values(spark, [text]).select("value").coalesce(1).write.format("records").option("startIndex", start).mode("append").save(path)

    def run():
        stream = spark.readStream.format("records").load(path).writeStream.format("records").option("path", out).option("checkpointLocation", out + "-state")
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(bytes(r.value).decode() for r in scan(spark, out).collect())

    add("five", 5)
    assert run() == ["five"]
    add("zero", 0)  # a lower number, later
    os.rename(os.path.join(path, "shard_0"), os.path.join(path, "shard_05"))  # ends in 5 too
    add("other", 0)
    assert run() == ["five", "other", "zero"]
    os.rename(os.path.join(path, "shard_0"), os.path.join(path, "shard_plain"))
    assert run() == ["five", "other", "other", "zero"]


def test_names_and_places_of_the_caller(spark, tmp_path):
    register(spark)
    path, df = str(tmp_path / "d"), values(spark, ["a", "b"]).select("value").coalesce(1)
    for _ in range(2):
        df.write.format("records").option("pathPattern", "part-{index:05d}.rec").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["part-00000.rec", "part-00001.rec"]
    assert scan(spark, path, pathPattern="part-{index:05d}.rec").count() == 4
    spark.dataSource.register(custom("own_records", lambda k: f"own {k}", lambda s: sorted((f.path, f.stat().st_size) for f in os.scandir(s.path) if f.name.startswith("own"))[::-1]))
    for text in ("x", "y"):
        values(spark, [text]).select("value").coalesce(1).write.format("own_records").mode("append").save(path)
    found = spark.read.format("own_records").option("metadata", "true").load(path).orderBy("shard_order").collect()
    assert [bytes(r.value) for r in found] == [b"y", b"x"] and os.path.exists(os.path.join(path, "own 1"))
    for bad in ({"pathPattern": "same"}, {"zstdLevel": "40", "compression": "zstd"}, {"chunkSize": "0"}, {"compression": "what"}):
        with pytest.raises(Exception, match="pathPattern|zstd level|chunkSize|compression"):
            df.write.format("records").options(**bad).mode("append").save(path)


def test_many_small_shards(spark, tmp_path):
    register(spark)
    values(spark, [f"{i:03}" for i in range(700)]).select("value").coalesce(1).write.format("records").options(maxBytesPerShard="6").mode("append").save(str(tmp_path / "d"))
    read = scan(spark, tmp_path / "d", metadata="true", shardOrder="numeric").collect()
    assert sorted((r.shard_order, r.chunk_record, bytes(r.value).decode()) for r in read) == [(i // 2, i % 2, f"{i:03}") for i in range(700)]


def test_sources_without_a_weight(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 0)], "source string, pos long")
    with pytest.raises(Exception, match="no weight for the source"):
        weighted_interleave(df, {"a": 1.0}, 1).collect()
    assert weighted_interleave(df, {"a": 1.0}, 1, default=2.0).where("arrival is null").count() == 0
    assert sorted((r.source or "", r.weight, r.records) for r in sources(df, {"a": 1.0}, 2.0).collect()) == [("", 2.0, 1), ("a", 1.0, 2), ("b", 2.0, 1)]
    with pytest.raises(InvalidOption):
        weighted_interleave(df, {"a": 1.0}, 1, default=0.0)


def test_row_index_has_no_gap(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    assert sorted(r.row_index for r in with_row_index(df, ["k"]).collect()) == list(range(1000))


def test_interleave_follows_weights_and_order(spark):
    table = spark.range(1500).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.col("id").alias("pos"))
    rows = weighted_interleave(table, {"a": 1.0, "b": 2.0, "c": 7.0}, 3).orderBy("arrival").collect()
    first = [r.source for r in rows[:500]]
    assert first.count("c") > first.count("b") > first.count("a") and len(rows) == 1500
    for s in "abc":
        places = [r.pos for r in rows if r.source == s]
        assert places == sorted(places)
    for bad in ({}, {"a": 0.0}):
        with pytest.raises(InvalidOption):
            weighted_interleave(table, bad, 3)


def test_reservoir_shuffle(spark):
    df = spark.range(500).coalesce(1)
    rows = reservoir_shuffle(df, 40, 7, "place").collect()
    assert sorted(r.id for r in rows) == list(range(500)) and [r.place for r in rows] == list(range(500))
    assert all(r.place >= r.id - 39 for r in rows)
    assert rows == reservoir_shuffle(df, 40, 7, "place").collect() != reservoir_shuffle(df, 40, 8, "place").collect()
    assert [r.id for r in reservoir_shuffle(df, 1, 7).collect()] == list(range(500))
    none, slots = reservoir_order(3, 3, np.random.default_rng(0), np.empty(0, np.int64), 0)
    assert none.tolist() == [] and slots.tolist() == [0, 1, 2]
    with pytest.raises(InvalidOption):
        reservoir_shuffle(df, 0, 7)


def test_epochs_are_permutations(spark):
    shards = spark.createDataFrame([(f"s{i}",) for i in range(9)], "shard_id string")
    rows = random_epochs(shards, 3, 5).orderBy("epoch", "rank").collect()
    by = [[r.shard_id for r in rows if r.epoch == e] for e in range(3)]
    assert all(sorted(b) == sorted(by[0]) for b in by) and by[0] != by[1]
    assert rows == random_epochs(shards, 3, 5).orderBy("epoch", "rank").collect()


def test_small_splits_share_tasks(spark, tmp_path):
    """Splits and shards are read in tasks of a bounded number, with the same rows; damage is still told of its shard."""
    texts, path = [f"r{i:05}" for i in range(8000)], str(tmp_path / "d")
    write_round_robin(values(spark, texts), path, 80, ["i"], chunkSize="100", blockSize="128")
    options = {"blockSize": "128", "splitBytes": "128"}
    read = scan(spark, path, **options)
    assert 8 <= read.rdd.getNumPartitions() <= 64
    assert sorted(bytes(r.value).decode() for r in read.collect()) == texts
    names = [f"{path}/shard_{k}" for k in range(80)]
    ordered = with_record_index(spark, path, shardPaths=json.dumps(names), **options)
    assert [bytes(r.value).decode() for r in reading_order(ordered, "round_robin").orderBy("position").collect()] == texts
    data = bytearray(open(names[7], "rb").read())
    data[400] ^= 255
    open(names[7], "wb").write(data)
    with pytest.raises(Exception, match="shard_7:"):
        scan(spark, path, **options).count()
    assert 7900 <= scan(spark, path, corruption="recover", **options).count() < 8000


def test_a_stream_reads_small_shards_together(spark, tmp_path):
    """Tasks of a micro-batch are of a bounded number, and hold every byte of every new shard once."""
    path = str(tmp_path / "d")
    write_round_robin(values(spark, [f"r{i}" for i in range(600)]), path, 150, ["i"])
    stream = RecordsStream(Settings({"path": path}))
    dealt = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert len(dealt) <= 64
    assert sorted((s.shard, s.start, s.stop) for t in dealt for s in t.splits) == sorted((p, 0, size) for p, size in shards(path))
    assert sorted(bytes(v).decode() for t in dealt for part in stream.read(t) for v in part.column(0).to_pylist()) == sorted(f"r{i}" for i in range(600))
