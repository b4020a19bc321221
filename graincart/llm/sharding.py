"""Sharding by balanced label propagation under capacity quotas.

Linked documents share a link key (for the registered query: a digest of equal texts). Labels are
shards. They start so that links are whole where quotas let them: the keys of at least 1 / ``LARGE``
of a quota, whose number is bounded, are dealt largest first, a key that fits to the shard with the
most room and a larger one to as many whole shards as it fills; all members of any other key start
in one shard, drawn by the room left. In each round every key with several members counts its members by shard; members elsewhere
want to move to the key's fullest shard with room, as all their neighbours there are links that
would no longer be cut; members of a shard where the key has more already, with room or without,
stay, so a key of more rows than a quota fills one shard after the other. Rounds end when no fewer
links are cut. A shard admits moves up to its quota: requests are counted by shard of origin and
target, and where they exceed the room each is granted with the share that fits, drawn by a hash of
the row, so no task sees all requests of a shard. Documents without a link have no wish; they fill
up what is left, which is what lets the sizes come out even.

The law is ``rows``: shard sizes in rows differ by at most one. Rows beyond a shard's final quota
(in the order: unlinked first) go to the shards with room, by ranks that are computed in buckets:
a shard's rows are dealt into buckets of about ``BUCKET_ROWS`` rows at any size of input, by a hash of
the key, or of the row where a key has more rows than a bucket; those come first, so that such a key
gives up its rows last. Ranks are counted inside buckets, and the buckets' counts added up in Spark.
Slots, gapless from 0, come from ranks of the same kind.

Defined results: null texts have size 8, checksum 0 and no link; null ids are placed like others;
repeated rows are rows of their own and linked by their text; with fewer rows than shards some
shards are empty; an empty table gives an empty result; result columns replace columns of the same
name.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import durable

SHARDS = 24
#: Keys of at least this part of a quota are dealt by a plan; there are at most ``SHARDS * LARGE`` such keys.
LARGE = 64
#: Rows of a rank bucket, in expectation, and buckets whose counts are added up together.
BUCKET_ROWS, BUCKET_GROUP = 2_000, 4_096


def _begins(counted: DataFrame, lead: str) -> DataFrame:
    """(lead, _bucket, _begin): the rows in buckets before each; totals run inside groups of buckets, then over the groups."""
    grouped = counted.withColumn("_group", F.floor(F.col("_bucket") / BUCKET_GROUP))
    before = lambda keys, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy(lead, "_group").agg(F.sum("n").alias("n")).select(lead, "_group", before([lead], "_group", "n").alias("_base"))
    inside = grouped.select(lead, "_bucket", "_group", before([lead, "_group"], "_bucket", "n").alias("_inside"))
    return inside.join(groups, [lead, "_group"]).select(lead, "_bucket", (F.col("_base") + F.col("_inside")).alias("_begin"))


def ranked(df: DataFrame, lead: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with a gapless rank from 0 inside each value of the int column ``lead``, buckets in order."""
    placed = df.withColumn("_bucket", bucket.cast("long"))
    counted = durable(placed.groupBy(lead, "_bucket").agg(F.count("*").alias("n")))
    inside = F.row_number().over(Window.partitionBy(lead, "_bucket").orderBy(*order))
    return placed.withColumn("_inside", inside).join(durable(_begins(counted, lead)), [lead, "_bucket"]).withColumn(out, F.col("_begin") + F.col("_inside") - 1).drop("_bucket", "_begin", "_inside")


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _plan(keys: list[tuple[str, int]], quota: list[int]) -> tuple[list[tuple[str, int, float, float]], list[int]]:
    """(key, shard, from, to) with the part of the key's members that starts in the shard, and the room left."""
    room, plan = list(quota), []
    for key, n in sorted(keys, key=lambda k: (-k[1], k[0])):
        left = n
        while left > 0:
            shard = max(range(len(room)), key=lambda s: (room[s], -s))
            part = min(left, room[shard]) or left
            plan.append((key, shard, (n - left) / n, (n - left + part) / n))
            room[shard] = max(0, room[shard] - part)
            left -= part
    return plan, room


def _started(linked: DataFrame, quota: list[int]) -> DataFrame:
    """``linked`` (uid, key, n) with the shard it starts in."""
    spark = linked.sparkSession
    large = linked.where(F.col("n") * LARGE >= max(1, min(quota))).select("key", "n").distinct().collect()
    plan, room = _plan([(r.key, r.n) for r in large], quota)
    weight = [x + 1 for x in room]
    ends = [sum(weight[: s + 1]) for s in range(len(weight))]
    drawn = F.pmod(F.xxhash64("key", F.lit(8)), F.lit(ends[-1]))
    other = F.coalesce(*[F.when(drawn < end, F.lit(s)) for s, end in enumerate(ends)])
    planned = F.broadcast(spark.createDataFrame(plan, "_key string, _shard int, _from double, _to double"))
    at = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    met = linked.withColumn("_at", at).join(planned, F.expr("key = _key and _at >= _from and _at < _to"), "left")
    return met.select("uid", "key", F.coalesce("_shard", other).cast("int").alias("shard"))


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``rows`` (uid, key, n: the key's members, ...) with a column ``shard`` that keeps links together.

    The quota of a shard holds in expectation after each round; ``balance`` makes it exact. Without
    ``rounds``, rounds go on until one cuts no fewer links than the one before.
    """
    spark = rows.sparkSession
    linked = rows.where("n > 1").select("uid", "key", "n")
    total = rows.count()
    if linked.isEmpty():
        return rows.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shards)).cast("int"))
    quota = _quotas(total, shards)
    linked = durable(_started(linked, quota))
    kept_before, before = -1, linked
    for turn in itertools.count() if rounds is None else range(rounds):
        sizes = {r.shard: r.n for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        open_shards = [s for s in range(shards) if sizes.get(s, 0) < quota[s]]
        held = durable(linked.groupBy("key", "shard").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("key", "shard")))
        kept = held.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0]
        if rounds is None and kept <= kept_before:
            linked = before
            break
        kept_before, before = kept, linked
        # the fullest shard of each key that still has room; ties by a hash of the key, so that keys spread
        wish = held.where(F.col("shard").isin(open_shards)).groupBy("key").agg(F.max(F.struct("n", "h", "shard")).alias("best"))
        # only from parts that rank below it: who is gathered in a full shard stays there
        moves = held.join(wish, "key").where(F.struct("n", "h", "shard") < F.col("best")).select("key", "shard", F.col("best.shard").alias("target"))
        wanted = linked.join(durable(moves), ["key", "shard"], "left").withColumn("target", F.coalesce("target", "shard"))
        wanted = durable(wanted)
        asks: dict[int, int] = {}
        leaves: dict[int, int] = {}
        for r in wanted.where("target != shard").groupBy("shard", "target").agg(F.count("*").alias("n")).collect():
            asks[r.target] = asks.get(r.target, 0) + r.n
            leaves[r.shard] = leaves.get(r.shard, 0) + r.n
        if not asks:
            break
        # room counts only half of what may leave, as those moves may be refused
        share = [(t, min(1.0, (quota[t] - sizes.get(t, 0) + leaves.get(t, 0) // 2) / n)) for t, n in asks.items()]
        shares = spark.createDataFrame(share, "target int, share double")
        drawn = F.pmod(F.xxhash64("uid", F.lit(100 + turn)), F.lit(1_000_000)) < F.col("share") * 1_000_000
        linked = durable(wanted.join(F.broadcast(shares), "target", "left").select("uid", "key", F.when(drawn, F.col("target")).otherwise(F.col("shard")).alias("shard")))
    placed = rows.where("n <= 1").withColumn("shard", F.lit(None).cast("int"))
    return placed.unionByName(rows.where("n > 1").join(linked.select("uid", "shard"), "uid"))


def balance(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Final shard and slot of every row: at most a row's difference between shards.

    Linked rows keep their shard up to its quota; all others are dealt to the room that is left.
    """
    spark = rows.sparkSession
    rows = durable(rows)
    total = rows.count()
    quota = _quotas(total, shards)
    buckets = total // (shards * BUCKET_ROWS) + 1
    small = F.col("n") <= BUCKET_ROWS  # copies stay side by side, but for those of a key larger than a bucket
    bucket = F.pmod(F.when(small, F.xxhash64("key", F.lit(3))).otherwise(F.xxhash64("uid", F.lit(3))), F.lit(buckets)) + F.when(small, buckets).otherwise(0)
    settled = ranked(rows.where("shard is not null"), "shard", bucket, [F.col("key"), F.col("uid")], "slot")
    limits = spark.createDataFrame(list(enumerate(quota)), "shard int, quota long")
    settled = durable(settled.join(F.broadcast(limits), "shard"))
    stays = settled.where("slot < quota").drop("quota")
    taken = {r.shard: r.n for r in stays.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    spare = rows.where("shard is null").unionByName(settled.where("slot >= quota").drop("quota", "slot")).withColumn("shard", F.lit(0))
    many = total // BUCKET_ROWS + 1
    dealt = ranked(spare, "shard", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(many)), [F.col("uid")], "rank")
    # the room of shard s holds the ranks from begin to begin + room
    begin, edges = 0, []
    for s in range(shards):
        room = quota[s] - taken.get(s, 0)
        edges.append((s, begin, begin + room, taken.get(s, 0)))
        begin += room
    shard = F.coalesce(*[F.when(F.col("rank") < end, F.lit(s)) for s, _, end, _ in edges])
    slot = F.coalesce(*[F.when(F.col("rank") < end, F.col("rank") - start + first) for _, start, end, first in edges])
    return stays.unionByName(dealt.withColumns({"slot": slot.cast("long"), "shard": shard.cast("int")}).drop("rank"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every document; links are equal texts."""
    data = F.encode(F.col(text_col), "utf-8")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(data).alias("digest"),
    )
    # a row without a text has a key of its own; uid tells rows apart, and is fixed by being written
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id())).withColumn("key", F.coalesce("digest", F.concat(F.lit("row "), F.col("uid").cast("string"))))
    copies = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    keyed = durable(rows.drop("digest").join(copies, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))))
    final = balance(propagate(keyed, shards, rounds), shards)
    return final.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
