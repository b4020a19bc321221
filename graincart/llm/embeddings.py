"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosines, components.

Each of ``tables`` hash tables takes the signs of a vector against ``bits`` random hyperplanes; two
vectors meet where all signs of a table agree. ``bits`` follows the logarithm of the row count and
``tables`` is the number that gives ``recall`` at the threshold itself, so pairs above it are found
more surely still.

1. Identical vectors are one entry with a count, so exact copies do not multiply.
2. An entry is dealt to its bucket of each table with a sketch of ``SKETCH`` further signs, without
   its vector. An entry goes on from a bucket only if some other entry there differs in at most
   ``most_signs`` of these; a pair at the threshold differs in more once in a thousand million times.
3. What is left is dealt again, with the vectors. Candidates are verified by their exact cosine in
   double precision, and a pair is counted in the first table in which it meets.

A bucket is cut into blocks of at most ``BLOCK`` entries, and each pair of blocks is a group of its
own: no task holds an unbounded bucket. What leaves a group is a row for each linked entry (its links
counted, and one edge of a spanning forest), never the pairs. Vectors are scaled by a power of two
before any product, so the largest and smallest finite ones link like others.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are kept as their own component; so do vectors of different lengths among each other;
repeated rows (even with one id) count as rows of their own; null ids never name a component (a group
of null ids has a null component and is not kept); an empty table gives an empty result; other columns
are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import durable
from graincart.llm.components import connected_components
from graincart.llm.simhash import _forest

THRESHOLD, RECALL, BLOCK, SEED = 0.95, 0.99, 1024, 97
#: Signs of the sketch (two words of 64).
SKETCH = 128


def plan_tables(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets of a few entries on spread data, and the wanted recall at the threshold."""
    bits = max(8, min(40, math.ceil(math.log2(max(rows, 2) / 8))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def most_signs(threshold: float = THRESHOLD, miss: float = 1e-9) -> int:
    """The signs of a sketch in which a pair at the threshold differs at most, but for a chance of ``miss``."""
    p, over = math.acos(threshold) / math.pi, 1.0
    for k in range(SKETCH):
        over -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if over <= miss:
            return k
    return SKETCH


def _scaled(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length in double precision, each scaled by a power of two so that its largest component is about 1."""
    vectors = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def _keyed(kind: str):
    """(id, vector) -> (id, digest, packed): both null for a vector that links with nothing."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # a null component becomes NaN
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            digests, packed, at = [], [], 0
            for size in sizes.tolist():
                vector = values[at : at + size] + 0.0  # one zero only
                at += size
                sound = size and np.isfinite(vector).all() and vector.any()
                packed.append(vector.tobytes() if sound else None)
                digests.append(hashlib.blake2b(packed[-1], digest_size=32).digest() if sound else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["_id", "digest", "packed"])

    return run


def _coded(bits: int, tables: int, seed: int, kind: str):
    """Entries with their codes in all tables (int64 each) and their sketch, packed."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = batch.column(batch.schema.get_field_index("packed")).to_pylist()
            lengths = np.fromiter(map(len, packed), np.int64, len(packed))
            codes, sketches = [b""] * len(packed), [b""] * len(packed)
            for length in np.unique(lengths):
                dim = int(length) // np.dtype(kind).itemsize
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables + SKETCH))
                rows = np.flatnonzero(lengths == length)
                signs = _scaled([packed[i] for i in rows], kind) @ planes[dim] >= 0
                code = (signs[:, : bits * tables].reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype("<i8")
                sketch = np.packbits(signs[:, bits * tables :], axis=1)
                for i, c, s in zip(rows, code, sketch, strict=True):
                    codes[i], sketches[i] = c.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(sketches, pa.binary())], [*batch.schema.names, "codes", "sketch"])

    return run


def _placed(tables: int):
    """(entry, codes, sketch, size) -> (bucket, entry, s0, s1) for each table; a bucket: its table and 48 bits of code and size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(n, tables)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8").reshape(n, 2)
            size = batch.column(3).to_numpy().astype(np.int64)
            for table in range(tables):
                bucket = (table << 48) | ((codes[:, table] ^ (size << 38)) & ((1 << 48) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], ["bucket", "entry", "s0", "s1"])

    return run


def _by_group(settle, names: list[str]):
    """Rows sorted by (bucket, i, j), each a pair of blocks -> what ``settle`` makes of each group of several rows."""

    def run(batches):
        import pyarrow as pa

        def groups(rows, last: bool):
            key = [rows.column(k).to_numpy() for k in range(3)]
            edges = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0), True])
            if not last:
                edges = edges[:-1]
            columns = [rows.column(k) for k in range(3, rows.num_columns)]
            columns = [c.to_numpy() if pa.types.is_integer(c.type) else np.array(c.to_pylist(), object) for c in columns]
            out = []
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if end - begin > 1 and (got := settle(*(int(k[begin]) for k in key), *(c[begin:end] for c in columns))) is not None:
                    out.append(got)
            made = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in made], names), rows.slice(int(edges[-1]))

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 8 * BLOCK:
                found, rest = groups(pa.Table.from_batches(held).combine_chunks(), False)
                held, size = rest.to_batches(), 0  # of a group that still goes on
                yield found
        if size or held:
            yield groups(pa.Table.from_batches(held).combine_chunks(), True)[0]

    return run


def _plausible(most: int):
    """Entries of a bucket that have a partner by their sketches."""

    def settle(bucket: int, i: int, j: int, block, entry, s0, s1):
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        differ = np.bitwise_count((s0[left][:, None] ^ s0[right]).view(np.uint64)).astype(np.int16) + np.bitwise_count((s1[left][:, None] ^ s1[right]).view(np.uint64))
        near = differ <= most
        if i == j:
            np.fill_diagonal(near, False)
        good = np.unique(np.r_[left[near.any(1)], right[near.any(0)]])
        return (np.full(len(good), bucket), entry[good]) if len(good) else None

    return _by_group(settle, ["bucket", "entry"])


def _linked(threshold: float, kind: str):
    """A row for each linked entry of a bucket: its links that no earlier table has seen, and an edge of a spanning forest."""

    def settle(bucket: int, i: int, j: int, block, entry, copies, packed, codes):
        table = bucket >> 48
        codes = np.frombuffer(b"".join(codes), "<i8").reshape(len(packed), -1)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        pairs = []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            vectors = _scaled(list(packed[own]), kind)
            unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
            left = np.flatnonzero(block[own] == i)
            right = left if i == j else np.flatnonzero(block[own] == j)
            x, y = np.nonzero(unit[left] @ unit[right].T >= threshold)
            x, y = own[left[x]], own[right[y]]
            pairs.append((x[x < y], y[x < y]) if i == j else (x, y))
        a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
        keep = []
        for k in range(0, len(a), 1 << 18):  # here the codes agree, and in no table before
            same = codes[a[k : k + (1 << 18)], : table + 1] == codes[b[k : k + (1 << 18)], : table + 1]
            keep.append(same[:, table] & ~same[:, :table].any(1))
        if not keep:
            return None
        a, b = a[np.concatenate(keep)], b[np.concatenate(keep)]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(entry)) + np.bincount(b, copies[a], len(entry))
        parent = np.arange(len(entry))
        _forest(a, b, parent)
        linked = np.flatnonzero(links > 0)
        return entry[linked], links[linked].astype(np.int64), entry[parent[linked]]

    return _by_group(settle, ["entry", "links", "other"])


def _blocked(rows: DataFrame, block: int, payload: list[str]) -> DataFrame:
    """Rows of buckets of several entries, sorted by (bucket, i, j): once for each pair of blocks that they belong to."""
    rows = durable(rows)
    sizes = durable(rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n"))
    cut = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("entry", F.lit(5)), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    return pairs.select("bucket", "i", "j", "block", "entry", *payload).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``."""
    name = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    keyed = durable(rows.mapInArrow(_keyed(kind), f"_id {name}, digest binary, packed binary"))
    distinct = keyed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("_id").alias("first"), F.first("packed").alias("packed"))
    bits, tables = plan_tables(keyed.count(), threshold, recall)
    coded = durable(distinct.mapInArrow(_coded(bits, tables, seed, kind), f"digest binary, copies long, first {name}, packed binary, codes binary, sketch binary").withColumn("entry", F.monotonically_increasing_id()))
    placed = coded.select("entry", "codes", "sketch", F.octet_length("packed").alias("size")).mapInArrow(_placed(tables), "bucket long, entry long, s0 long, s1 long")
    plausible = _blocked(placed, block, ["s0", "s1"]).mapInArrow(_plausible(most_signs(threshold)), "bucket long, entry long").distinct()
    whole = plausible.join(coded.select("entry", "copies", "packed", "codes"), "entry")
    found = _blocked(whole, block, ["copies", "packed", "codes"]).mapInArrow(_linked(threshold, kind), "entry long, links long, other long")
    linked = durable(found.groupBy("entry", "other").agg(F.sum("links").alias("links")))
    degrees = linked.groupBy("entry").agg(F.sum("links").alias("links"))
    groups = connected_components(linked.where("entry != other"), "entry", "other")
    rooted = coded.select("digest", "entry", "copies", "first").join(degrees, "entry", "left").join(groups, F.col("entry") == F.col("node"), "left").withColumn("root", F.coalesce("component", "entry"))
    rooted = durable(rooted.select("digest", "copies", "first", "links", "root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(rooted.join(names, "root").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # a row that links with nothing has a key of its own, lest all of them land in one task
    key = F.coalesce("digest", F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary"))
    result = keyed.select("_id", key.alias("digest"), F.col("digest").isNull().alias("alone")).join(named, "digest", "left")
    component = F.when(F.col("alone"), F.col("_id")).otherwise(F.col("component_id"))
    return result.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
