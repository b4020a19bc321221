"""Registered queries of the record engine, and the SQL that gives the same rows.

Each makes records of a whole table, writes them through the sink into shared scratch space, and
computes its result from what the scan gives back; the SQL computes it from the table itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.functions.encoding import chunk_end, varint_size
from graincart.operators.ordering import reading_order, with_record_index, with_row_index
from graincart.operators.sampling import reservoir_shuffle, weighted_interleave
from graincart.operators.scratch import scratch_path
from graincart.operators.sharding import append_in_place, decode_shards, random_epochs, write_round_robin
from graincart.sources.records import filesystem, register, shards
from graincart.streaming.repeat import random_read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(make):
        QUERIES[make.__name__] = make
        ORACLE_SQL[make.__name__] = sql
        return make

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an id line and the text."""
    return table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary").alias("value"))


def keys(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Records of ten bytes: a key with leading zeros."""
    return table(spark, sf_dir, name).select(F.col(key).alias("key"), F.lpad(F.col(key).cast("string"), 10, "0").cast("binary").alias("value"))


def indexed(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return with_record_index(spark, path, **options)


def stored(df: DataFrame, name: str, mode: str = "append", **options) -> str:
    path = scratch_path(df.sparkSession, name)
    register(df.sparkSession)
    df.select("value").write.format("records").options(**options).mode(mode).save(path)
    return path


def scan(spark: SparkSession, path: str, form: str = "records", **options) -> DataFrame:
    register(spark)
    return spark.read.format(form).options(**options).load(path)


def digests(records: DataFrame) -> DataFrame:
    line = F.split(F.col("value").cast("string"), "\n", 2)
    return records.select(line[0].cast("long").alias("doc_id"), line[1].alias("text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def flipped(path: str, at: int) -> None:
    """The first shard of a folder with one byte inverted, rewritten in blocks."""
    name, size = shards(path)[0]
    system, _ = filesystem(path)
    if at >= size:
        raise ValueError(f"{name} has {size} bytes, too few for a fault at {at}")
    done = 0
    with system.open_input_stream(name) as old, system.open_output_stream(name + ".new") as new:
        while part := old.read(8 << 20):
            if done <= at < done + len(part):
                part = bytearray(part)
                part[at - done] ^= 255
                part = bytes(part)
            new.write(part)
            done += len(part)
    system.move(name + ".new", name)


_DIGESTS = "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents"
_NUMBERED = "SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer"
_ORDERS = "SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders"


def decoded(records: DataFrame) -> DataFrame:
    return records.withColumn("key", F.col("value").cast("string").cast("long"))


@query(_DIGESTS)
def rec_roundtrip(spark, sf_dir):
    return digests(scan(spark, stored(documents(spark, sf_dir), "roundtrip")))


@query(_DIGESTS)
def rec_zstd_roundtrip(spark, sf_dir):
    return digests(scan(spark, stored(documents(spark, sf_dir), "zstd", compression="zstd", zstdLevel="3")))


@query(_DIGESTS)
def rec_unhashed_roundtrip(spark, sf_dir):
    return digests(scan(spark, stored(documents(spark, sf_dir), "unhashed", dataHash="none", splitBytes="65536"), splitBytes="262144"))


@query(_DIGESTS)
def rec_memory_shards(spark, sf_dir):
    path = stored(documents(spark, sf_dir), "memory", maxBytesPerShard=str(4 << 20))
    return digests(decode_shards(spark.read.format("binaryFile").load(path + "/shard_*")))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_day FROM orders")
def rec_typed_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    path = stored(orders.select(F.to_json(F.struct("*")).cast("binary").alias("value")), "typed")
    return scan(spark, path).select(F.from_json(F.col("value").cast("string"), kind).alias("r")).select("r.*")


@query("SELECT count(*) AS records, CAST(sum(octet_length(encode(doc_id || chr(10) || coalesce(text, '')))) AS BIGINT) AS bytes FROM documents")
def rec_count_size(spark, sf_dir):
    return scan(spark, stored(documents(spark, sf_dir), "count")).agg(F.count("*").alias("records"), F.sum(F.length("value")).alias("bytes"))


@query("SELECT CAST(sum(ascii(CAST(doc_id AS VARCHAR))) AS BIGINT) AS checksum FROM documents")
def rec_first_byte_checksum(spark, sf_dir):
    first = F.when(F.length("value") > 0, F.ascii(F.substring(F.col("value"), 1, 1).cast("string"))).otherwise(0)
    return scan(spark, stored(documents(spark, sf_dir), "first")).agg(F.sum(first).alias("checksum"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE octet_length(encode(source)) END AS bytes, count(*) AS records FROM documents GROUP BY 1")
def rec_empty_records(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).cast("binary")
    path = stored(table(spark, sf_dir, "documents").select(value.alias("value")), "empty")
    return scan(spark, path).groupBy(F.length("value").cast("long").alias("bytes")).agg(F.count("*").alias("records"))


@query("SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def rec_append_shards(spark, sf_dir):
    path = stored(keys(spark, sf_dir), "append")
    keys(spark, sf_dir, "supplier", "s_suppkey").select("value").write.format("records").mode("append").save(path)
    return decoded(scan(spark, path)).select("key")


@query("SELECT s_suppkey AS key FROM supplier")
def rec_overwrite_shards(spark, sf_dir):
    path = stored(keys(spark, sf_dir), "overwrite")
    keys(spark, sf_dir, "supplier", "s_suppkey").select("value").write.format("records").mode("overwrite").save(path)
    return decoded(scan(spark, path)).select("key")


@query("SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def rec_append_inplace(spark, sf_dir):
    path = stored(keys(spark, sf_dir).coalesce(1), "inplace")
    append_in_place(keys(spark, sf_dir, "supplier", "s_suppkey"), shards(path)[0][0], ["key"])
    return decoded(scan(spark, path)).select("key")


@query(f"SELECT key, CAST(i % 4 AS INTEGER) AS shard, i // 4 AS place FROM ({_NUMBERED})")
def rec_shard_round_robin(spark, sf_dir):
    path = scratch_path(spark, "robin")
    write_round_robin(keys(spark, sf_dir), path, 4, ["key"])
    return decoded(indexed(spark, path, splitBytes="65536")).select("key", F.col("shard_order").alias("shard"), F.col("record_index").alias("place"))


@query(f"SELECT i // 100 AS shard, count(*) AS records FROM ({_NUMBERED}) GROUP BY 1")
def rec_auto_shard_bytes(spark, sf_dir):
    path = stored(keys(spark, sf_dir).orderBy("key").coalesce(1), "auto", maxBytesPerShard="1000")
    read = scan(spark, path, metadata="true", shardOrder="numeric")
    return read.groupBy(F.col("shard_order").cast("long").alias("shard")).agg(F.count("*").alias("records"))


@query(f"SELECT c, n AS num_records, 10 * n AS decoded_size FROM (SELECT i // 100 AS c, count(*) AS n FROM ({_NUMBERED}) GROUP BY 1)")
def rec_chunk_layout(spark, sf_dir):
    path = stored(keys(spark, sf_dir).orderBy("key").coalesce(1), "chunks", chunkSize="1000")
    return with_row_index(scan(spark, path, "record_chunks"), ["chunk_begin"], "c").select("c", "num_records", "decoded_size")


@query("SELECT l_orderkey, l_linenumber, CAST(b + s + ((s + (b + 65511) % 65536) // 65512) * 24 AS BIGINT) AS chunk_end FROM (SELECT *, l_orderkey * 977 AS b, l_partkey * 31 + 40 AS s FROM lineitem)")
def rec_block_layout(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 977).alias("b"), (F.col("l_partkey") * 31 + 40).alias("s"))
    return made.select("l_orderkey", "l_linenumber", chunk_end(F.col("b"), F.col("s")).cast("long").alias("chunk_end"))


@query("SELECT o_orderkey, CASE WHEN v < 127 THEN 1 WHEN v < 127*128 THEN 2 WHEN v < 127*128*128 THEN 3 WHEN v < 127*128*128*128 THEN 4 ELSE 5 END AS bytes FROM (SELECT o_orderkey, o_orderkey * o_custkey AS v FROM orders)")
def rec_varint_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", varint_size(F.col("o_orderkey") * F.col("o_custkey")).alias("bytes"))


@query("SELECT count(*) AS records FROM documents")
def rec_metadata_count(spark, sf_dir):
    return scan(spark, stored(documents(spark, sf_dir), "meta"), "record_chunks").agg(F.sum("num_records").alias("records"))


_PAYLOAD = "40 + n // 100 * 1142 + CASE WHEN n % 100 > 0 THEN 42 + 11 * (n % 100) ELSE 0 END"


@query(f"SELECT CAST(ceil(({_PAYLOAD}) / 4072.0) AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS faults FROM (SELECT count(*) AS n FROM orders)")
def rec_block_scan(spark, sf_dir):
    path = stored(keys(spark, sf_dir, "orders", "o_orderkey").orderBy("key").coalesce(1), "blocks", chunkSize="1000", blockSize="4096")
    return scan(spark, path, "record_blocks", blockSize="4096", splitBytes="16384").agg(F.count("*").alias("blocks"), F.count("fault").alias("faults"))


@query(f"SELECT key, row_number() OVER (ORDER BY i % 3, i) - 1 AS position FROM ({_NUMBERED})")
def rec_order_drain(spark, sf_dir):
    path = scratch_path(spark, "drain")
    write_round_robin(keys(spark, sf_dir), path, 3, ["key"], chunkSize="500", blockSize="4096")
    return decoded(reading_order(indexed(spark, path, splitBytes="4096", blockSize="4096"), "drain")).select("key", "position")


@query(f"SELECT key, i AS position FROM ({_NUMBERED})")
def rec_order_round_robin(spark, sf_dir):
    path = scratch_path(spark, "turns")
    write_round_robin(keys(spark, sf_dir), path, 3, ["key"], chunkSize="500", blockSize="4096")
    return decoded(reading_order(indexed(spark, path, splitBytes="4096", blockSize="4096"), "round_robin")).select("key", "position")


_PARTS = f"SELECT key, i, CASE WHEN 5 * i < n THEN 0 WHEN 2 * i < n THEN 1 ELSE 2 END AS shard FROM ({_NUMBERED}), (SELECT count(*) AS n FROM customer)"


@query(f"""
WITH parts AS ({_PARTS}), placed AS (SELECT key, shard, row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY shard) AS n FROM parts),
     ends AS (SELECT min(n) FILTER (WHERE shard = 0) AS a, min(n) FILTER (WHERE shard = 1) AS b FROM placed)
SELECT key, row_number() OVER (ORDER BY CASE WHEN shard < 2 THEN k ELSE least(a, b) + 1 + k END, CASE WHEN shard < 2 THEN shard WHEN a <= b THEN 0 ELSE 1 END) - 1 AS position FROM placed, ends
""")
def rec_capped_round_robin(spark, sf_dir):
    path, total = scratch_path(spark, "capped"), table(spark, sf_dir, "customer").count()
    numbered = with_row_index(keys(spark, sf_dir), ["key"], "i")
    part = F.when(5 * F.col("i") < total, 0).when(2 * F.col("i") < total, 1).otherwise(2)
    for shard in range(3):
        write_round_robin(numbered.where(part == shard), path, 1, ["i"])
    return decoded(reading_order(indexed(spark, path), "round_robin", max_concurrent_shards=2)).select("key", "position")


@query(f"""
SELECT epoch, rank, key FROM (SELECT key, 'shard_' || (i % 4) AS shard FROM ({_NUMBERED})) JOIN
  (SELECT epoch, shard, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || shard), shard) - 1 AS rank
   FROM (SELECT unnest(['shard_0', 'shard_1', 'shard_2', 'shard_3']) AS shard), (SELECT unnest([0::BIGINT, 1, 2]) AS epoch)) USING (shard)
""")
def rec_random_read(spark, sf_dir):
    path = scratch_path(spark, "repeat")
    write_round_robin(keys(spark, sf_dir), path, 4, ["key"])
    return decoded(random_read(spark, path, 3, 7)).select("epoch", "rank", "key")


@query(f"SELECT DISTINCT 'shard_' || (i % 12) AS name, CAST(dense_rank() OVER (ORDER BY 'shard_' || (i % 12)) - 1 AS INTEGER) AS shard_order FROM ({_NUMBERED})")
def rec_lexicographic_shards(spark, sf_dir):
    path = scratch_path(spark, "names")
    write_round_robin(keys(spark, sf_dir), path, 12, ["key"])
    return scan(spark, path, metadata="true").select(F.substring_index("shard_id", "/", -1).alias("name"), "shard_order").distinct()


@query("SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || source), source) - 1 AS INTEGER) AS rank, source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (SELECT unnest([0, 1, 2]) AS epoch)")
def rec_random_epochs(spark, sf_dir):
    return random_epochs(table(spark, sf_dir, "documents").where("source is not null"), 3, 7, "source")


_RACE = """
SELECT source, pos, row_number() OVER (ORDER BY t, source, pos) - 1 AS rank FROM (
  SELECT source, pos, sum(-ln((CAST(('0x' || substr(md5('5:' || source || ':' || pos), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / w) OVER (PARTITION BY source ORDER BY pos) AS t
  FROM (SELECT o_orderpriority AS source, o_orderkey AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 2.0 ELSE 1.0 END AS w FROM orders))
"""


@query(_RACE)
def rec_weighted_interleave(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("pos"))
    return with_row_index(weighted_interleave(orders, {"1-URGENT": 5.0, "2-HIGH": 2.0}, 5, default=1.0), ["arrival", "source", "pos"], "rank").drop("arrival")


_FILES = "SELECT 'a' AS source, c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, 2.0 AS w FROM customer UNION ALL SELECT 'b', s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1, 1.0 FROM supplier"


@query(f"""
SELECT source, key, row_number() OVER (ORDER BY t, source, pos) - 1 AS rank FROM (
  SELECT source, key, pos, sum(-ln((CAST(('0x' || substr(md5('5:' || source || ':' || pos), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / w) OVER (PARTITION BY source ORDER BY pos) AS t FROM ({_FILES}))
""")
def rec_sampling_read(spark, sf_dir):
    files = None
    for source, *columns in (("a", "customer", "c_custkey"), ("b", "supplier", "s_suppkey")):
        path = scratch_path(spark, "sampled")
        write_round_robin(keys(spark, sf_dir, *columns), path, 1, ["key"])
        read = decoded(indexed(spark, path)).select(F.lit(source).alias("source"), "key", F.col("record_index").alias("pos"))
        files = read if files is None else files.unionByName(read)
    return with_row_index(weighted_interleave(files, {"a": 2.0, "b": 1.0}, 5), ["arrival", "source", "pos"], "rank").select("source", "key", "rank")


@query("SELECT r_regionkey AS key, md5(repeat(r_regionkey || '-' || r_name || ' ', 100000)) AS digest, CAST(octet_length(encode(repeat(r_regionkey || '-' || r_name || ' ', 100000))) AS BIGINT) AS bytes FROM region")
def rec_large_records(spark, sf_dir):
    value = F.expr("repeat(concat(r_regionkey, '-', r_name, ' '), 100000)").cast("binary")
    read = scan(spark, stored(table(spark, sf_dir, "region").select(value.alias("value")), "large"))
    return read.select(F.substring_index(F.col("value").cast("string"), "-", 1).cast("int").alias("key"), F.md5("value").alias("digest"), F.length("value").cast("long").alias("bytes"))


@query("SELECT c_custkey AS key FROM customer")
def rec_reservoir_shuffle(spark, sf_dir):
    return decoded(reservoir_shuffle(scan(spark, stored(keys(spark, sf_dir), "reservoir")), 64, 42)).select("key")


@query(f"SELECT key FROM ({_ORDERS}) WHERE i NOT BETWEEN 100 AND 199")
def rec_recover_data_flip(spark, sf_dir):
    path = stored(keys(spark, sf_dir, "orders", "o_orderkey").orderBy("key").coalesce(1), "flip", chunkSize="1000", blockSize="4096")
    flipped(path, 1206 + 40 + 200)  # in the data of the second chunk
    return decoded(scan(spark, path, corruption="recover", blockSize="4096")).select("key")


@query(f"SELECT key FROM ({_ORDERS}) WHERE i NOT BETWEEN 300 AND 399")
def rec_recover_block_header(spark, sf_dir):
    path = stored(keys(spark, sf_dir, "orders", "o_orderkey").orderBy("key").coalesce(1), "header", chunkSize="1000", blockSize="4096")
    flipped(path, 4096 + 3)  # the second block header lies in the fourth chunk
    return decoded(scan(spark, path, corruption="recover", blockSize="4096")).select("key")


@query(f"SELECT key FROM ({_ORDERS}) WHERE i NOT BETWEEN 300 AND 399")
def rec_recover_in_splits(spark, sf_dir):
    path = stored(keys(spark, sf_dir, "orders", "o_orderkey").orderBy("key").coalesce(1), "splits", chunkSize="1000", blockSize="4096")
    flipped(path, 4096 + 3)
    return decoded(scan(spark, path, corruption="recover", blockSize="4096", splitBytes="4096")).select("key")


@query("SELECT CAST(1206 AS BIGINT) AS skipped_at")
def rec_skip_report(spark, sf_dir):
    path = stored(keys(spark, sf_dir, "orders", "o_orderkey").orderBy("key").coalesce(1), "skips", chunkSize="1000", blockSize="4096")
    flipped(path, 1206 + 40 + 200)
    return scan(spark, path, "record_skips", blockSize="4096").select("skipped_at")


@query(_DIGESTS)
def rec_stream_shards(spark, sf_dir):
    path, out = stored(documents(spark, sf_dir), "stream", maxBytesPerShard=str(4 << 20)), scratch_path(spark, "streamed")
    stream = spark.readStream.format("records").load(path).writeStream.format("records").option("path", out).option("checkpointLocation", out + "-state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return digests(scan(spark, out))


@query("SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def rec_scan_join_agg(spark, sf_dir):
    read = decoded(scan(spark, stored(keys(spark, sf_dir, "orders", "o_custkey"), "joined")))
    return read.join(table(spark, sf_dir, "customer"), F.col("key") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"))
