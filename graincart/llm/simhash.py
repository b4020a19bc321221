"""SimHash near-duplicates: 64-bit fingerprints, linked where few bits differ, found by anchor points.

Fingerprint: ASCII letters lower-cased, words split at ASCII white space, shingles of ``SHINGLE``
words, XXH64 (seed 42) of each, repeats included; a bit is set if it is set in over half of them.

Search: two fingerprints that differ in at most two of 64 bits differ in at most one bit of one of
two disjoint 31-bit parts. On each part the anchors are the words of the perfect Hamming code
[31, 26]: a covering code of radius 1. A fingerprint is replicated to every anchor within covering
radius plus threshold, 1 + 1 = 2: that is one anchor or 16. Of two linked fingerprints, the anchor
that covers the first is one of the second's, so they meet there, and each anchor compares its own.
Identical fingerprints are one entry, so copies do not multiply.

An anchor with more than ``ANCHOR_LIMIT`` entries is not compared in one task. Its entries are
linked through midpoints instead, which is exact too: two words differ in at most two bits if and
only if some word lies within one bit of both. Each entry goes to the 65 words within one bit of
it, and a midpoint cannot hold more than 65 entries.

Defined results: null texts and texts without a word have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows keep their rows; null ids never
name a component (a group with null ids only has a null component); an empty table gives an empty
result; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, durable
from graincart.llm.components import connected_components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Entries that one anchor compares at most; beyond it midpoints link them.
ANCHOR_LIMIT = 4096
_LANES = np.uint64(0x0101010101010101)
_BLOCK = 255  # the most ones that a byte lane can add up
_HASHES = 1 << 20


def _shingle_hashes(text: str | None, shingle: int) -> list[int]:
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return [digest(join(words), SEED)]
    return [digest(s, SEED) for s in map(join, zip(*(words[i:] for i in range(shingle)), strict=False))]


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes, the word of the bits set in over half of it; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    starts, blocks = np.cumsum(sizes) - sizes, -(-sizes // _BLOCK)
    first = np.cumsum(blocks) - blocks
    cuts = np.repeat(starts, blocks) + _BLOCK * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    words = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > sizes[:, None]).astype(np.uint64)
        for byte in range(8):
            words |= over[:, byte] << np.uint64(8 * byte + bit)
    out[full] = words
    return out


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of texts."""
    done: list[np.ndarray] = []
    held: list[np.ndarray] = []
    total = 0
    for text in texts:
        held.append(np.array(_shingle_hashes(text, shingle), np.uint64))
        total += len(held[-1])
        if total > _HASHES:
            done.append(_majorities(np.concatenate(held), np.array([len(h) for h in held])))
            held, total = [], 0
    if held:
        done.append(_majorities(np.concatenate(held), np.array([len(h) for h in held])))
    return np.concatenate(done) if done else np.empty(0, np.uint64)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints_of(texts.tolist(), shingle).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long").asNondeterministic()(text)


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _near_codewords() -> list[list[int]]:
    """For each syndrome of the Hamming code [31, 26], the changes of at most two bits that lead to a codeword."""
    changes: list[list[int]] = [[] for _ in range(32)]
    changes[0].append(0)
    for i in range(31):
        changes[i + 1].append(1 << i)
        for j in range(i):
            changes[(i + 1) ^ (j + 1)].append((1 << i) | (1 << j))
    return changes


def anchors(fp: Column) -> Column:
    """Every anchor of a fingerprint, of both parts, as an array of longs."""
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in row]) for row in _near_codewords()])

    def of_part(part: int) -> Column:
        word = F.shiftrightunsigned(fp, 32 * part).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
        syndrome = sum((F.bit_count(word.bitwiseAND(F.lit(sum(1 << i for i in range(31) if (i + 1) >> k & 1)).cast("long"))) % 2) * (1 << k) for k in range(5))
        high = F.lit(part << 31).cast("long")
        return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda change: word.bitwiseXOR(change).bitwiseOR(high))

    return F.concat(of_part(0), of_part(1))


def _forest(i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> None:
    """Merge the pairs into ``parent``, which ends with every entry pointing to the first of its set."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _compare(threshold: int, limit: int):
    """Rows sorted by anchor -> (a, b) links that span the sets of linked entries, or (a, null) of crowded anchors."""

    def settle(keys: np.ndarray, fps: np.ndarray):
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[edge, len(keys)])
        crowded = np.repeat(sizes > limit, sizes)
        hot = np.unique(fps[crowded])
        keys, fps = keys[~crowded], fps[~crowded]
        words, parent = fps.view(np.uint64), np.arange(len(fps))
        at, held, total = np.arange(len(fps)), [], 0
        for step in range(1, limit):
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(words[at] ^ words[at + step]) <= threshold]
            if len(near):
                held.append((near, near + step))
                total += len(near)
            if total > 1 << 21:
                _forest(*map(np.concatenate, zip(*held, strict=True)), parent)
                held, total = [], 0
        if held:
            _forest(*map(np.concatenate, zip(*held, strict=True)), parent)
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return fps[moved], fps[parent[moved]], hot

    def run(batches):
        import pyarrow as pa

        def rows(a, b, hot):
            ends = pa.array(np.r_[b, np.zeros(len(hot), np.int64)], mask=np.r_[np.zeros(len(b), bool), np.ones(len(hot), bool)])
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, hot]), ends], ["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        held, total = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            total += batch.num_rows
            if total > 1 << 18:
                keys, fps = (np.concatenate([x, *y]) for x, y in zip((keys, fps), zip(*held, strict=True), strict=True))
                held, total = [], 0
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut == 0 and len(keys) > limit:  # a crowded anchor: let go all but enough to know it again
                    yield rows(np.empty(0, np.int64), np.empty(0, np.int64), np.unique(fps))
                    keys, fps = keys[: limit + 1], fps[: limit + 1]
                elif cut:
                    yield rows(*settle(keys[:cut], fps[:cut]))
                    keys, fps = keys[cut:], fps[cut:]
        if held:
            keys, fps = (np.concatenate([x, *y]) for x, y in zip((keys, fps), zip(*held, strict=True), strict=True))
        if len(keys):
            yield rows(*settle(keys, fps))

    return run


def link_fingerprints(fps: DataFrame, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(a, b) links whose components are those of all pairs at ``THRESHOLD`` or fewer bits; ``fps``: distinct ``fp``."""
    dealt = fps.select(F.explode(anchors(F.col("fp"))).alias("anchor"), "fp").repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = durable(dealt.mapInArrow(_compare(THRESHOLD, limit), "a long, b long").distinct())
    crowded = found.where("b is null").select("a").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    meets = crowded.select("a", F.explode(F.transform(steps, lambda s: F.col("a").bitwiseXOR(s))).alias("z")).groupBy("z").agg(F.collect_set("a").alias("all")).where(F.size("all") > 1)
    through = meets.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b")
    return found.where("b is not null").unionByName(through.distinct())


def fingerprint_roots(distinct: DataFrame, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """``distinct`` (fp, first) with ``root``, any fingerprint of the group that links at ``THRESHOLD`` bits make."""
    groups = connected_components(link_fingerprints(distinct.select("fp"), limit))
    return distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id, root) of every document; ``root`` is any fingerprint of the group."""
    marked = durable(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col)).alias("fp")))
    distinct = durable(marked.groupBy("fp").agg(F.min("_id").alias("first")))
    rooted = durable(fingerprint_roots(distinct, limit))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(rooted.join(names, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select(F.col("_id").alias(id_col), as_hex("fp").alias("fingerprint"), "component_id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies (by fingerprints and ``jaccard``): the one with the smallest id.

    Of rows of a group that share this id, any one stays; an id that stands in several groups is judged
    in each. Rows without an id stay only as the one row of a group in which no row has an id. Rows are
    known by id and text: those to drop are broadcast where they are few, so kept texts do not move.
    """
    from graincart.llm.jaccard import BROADCAST, near_copies, text_key

    rooted = durable(near_copies(docs, id_col, text_col))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("first"))
    keep = durable(first.select("first._id", "first._key").distinct())
    pairs = durable(rooted.groupBy("_id", "_key").agg(F.count("*").alias("n")))

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        if right.limit(BROADCAST + 1).count() <= BROADCAST:
            right = F.broadcast(right)
        return left.join(right, left["_id"].eqNullSafe(right["_id"]) & (left["_key"] == right["_key"]), how)

    drops = durable(met(pairs, keep, "left_anti").select("_id", "_key"))
    repeated = durable(met(pairs.where("n > 1"), keep, "left_semi").select("_id", "_key"))
    rows = docs.select(boxed(docs), F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    single = met(met(rows, drops, "left_anti"), repeated, "left_anti")
    several = met(rows, repeated, "left_semi").dropDuplicates(["_id", "_key"])
    return single.unionByName(several).select("row.*")
