"""Near copies by SimHash and by exact Jaccard similarity of word shingles: prefix filter, verification, components.

Words are those of ``simhash`` (ASCII letters lower-cased, split at ASCII white space); a text is the
set of its shingles of ``SHINGLE`` words (all words, if fewer). Two texts are linked where the sets'
similarity, shared over all, is 4/5 or more, compared in integers. Texts with equal sets are one
entry, so copies do not multiply; texts without a word have the empty set and are one entry.

Fingerprints of ``simhash`` come first: texts whose fingerprints differ in at most two bits are linked,
as in query 7, and what these links join need not meet again. SimHash alone cannot find the rest: two
texts at similarity 0.8 differ in about ten of 64 bits. So the further search is by shared shingles: similar sets share at least four fifths of the larger. With the shingles of
every set in one order, the first n - ceil(4n/5) + 1 of two such sets therefore have one in common, so
each entry goes to these of its shingles, and no pair is missed. Any order will do; it is by count in a
sample of texts, then by hash, so that common passages come last and rarely make a bucket. Only buckets
of several entries go on, cut into blocks of about ``BLOCK`` entries. A passage that some texts share makes
a bucket of the same entries for each of its shingles: one stands for them all, with their number as weight.

1. In a few rounds, neighbours in an order of each block that are not yet in one component become
   candidates, of each entry the ``NEAREST`` that it meets most often. That joins the large groups of
   near copies with a number of candidates that grows with the entries.
2. Then every pair of a bucket whose ends are still apart is one.

Candidates that cannot be similar go by sizes and by parities: the set bits of a sketch say in which
classes of hashes a text has an odd number of shingles; sets that differ in d shingles differ in at
most d bits, and a sketch has about as many bits as the set has shingles. Only what passes is verified
by the sets themselves. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import durable, kept
from graincart.llm.components import connected_components
from graincart.llm.simhash import _shingle_hashes, fingerprint_roots, fingerprints_of

SHINGLE = 5
#: Texts, about, whose shingles are counted for the order, and the shingles of the sample that count as common.
SAMPLE, COMMON, MOST_COMMON = 16_000, 2, 500_000
#: Entries of a block; rows of ids that are broadcast at most, more being joined by a shuffle; candidates of an entry in a round.
BLOCK, BROADCAST, NEAREST, ROUNDS = 1024, 100_000, 2, 3
#: Columns of 64 parities each; a power of two.
PARITY = tuple(f"p{k}" for k in range(16))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(_shingle_hashes(text, SHINGLE), np.uint64))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def text_key(text: Column) -> Column:
    """A text's number; null texts have one too."""
    return F.xxhash64(text.cast("string"))


def _digest(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _shingles(batches):
    """Texts -> one row for each shingle of each."""
    import pyarrow as pa

    kept("near copies")
    for batch in batches:
        found = [shingle_set(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["key"])


def _sketch(shingles: np.ndarray) -> bytes:
    """The parity of each of 1024 classes of hashes, or of the power of two that is at least the number of shingles."""
    bits = max(64 * len(PARITY), 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64-bit words as one of fewer: classes that fall together add up."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _marked(common: np.ndarray, counts: np.ndarray):
    """(_id, _key, text) -> (_id, _key, fp, entry, n, prefix, sketch, parities)."""

    def run(batches):
        import pyarrow as pa

        kept("near copies")
        for batch in batches:
            rows, texts = [], batch.column(2).to_pylist()
            for text in texts:
                shingles = shingle_set(text)
                seen = np.zeros(len(shingles), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
                    seen = np.where(common[at] == shingles, counts[at], 0)
                first = shingles[np.lexsort((shingles, seen))[: prefix_size(len(shingles))]]
                sketch = _sketch(shingles)
                parity = _folded(np.frombuffer(sketch, "<i8"), len(PARITY))
                rows.append((_digest(shingles), len(shingles), first.view(np.int64), sketch, *parity.tolist()))
            entry, n, first, sketch, *parity = zip(*rows, strict=True) if rows else ((),) * (4 + len(PARITY))
            columns = [
                batch.column(0), batch.column(1), pa.array(fingerprints_of(texts).view(np.int64)), pa.array(np.array(entry, np.uint64).view(np.int64)), pa.array(n, pa.int32()),
                pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), *(pa.array(p, pa.int64()) for p in parity),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "fp", "entry", "n", "prefix", "sketch", *PARITY])

    return run


def _plausible(batches):
    """(a, b, n, m, left, right) -> (a, b) of the pairs whose sketches do not rule them out."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for n, m, left, right in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            x, y = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
            words = min(len(x), len(y))
            keep.append(5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= n + m)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _sets(batches):
    """Texts -> (entry, packed): the entry's shingles, sorted."""
    import pyarrow as pa

    for batch in batches:
        found = [shingle_set(t) for t in batch.column(0).to_pylist()]
        entries = np.array([_digest(s) for s in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array([s.tobytes() for s in found], pa.binary())], ["entry", "packed"])


def _similar(batches):
    """(a, b, left, right) -> (a, b) of the similar pairs."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _block_pairs(batches):
    """Rows sorted by (key, i, j), each a pair of blocks of a bucket -> (a, b) that may be similar and are apart."""
    import pyarrow as pa

    def settle(rows: list[np.ndarray]):
        _, i, j, block, n, entry, root, *parity = rows
        left = np.flatnonzero(block == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(block == j[0])
        if not len(left) or not len(right):
            return None
        x, y = left[:, None], right[None, :]
        may = (root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        a, b = np.nonzero(may)
        a, b = left[a], right[b]
        apart = np.zeros(len(a), np.int64)
        for p in parity:  # the bits so far are a bound too, so most pairs go early
            apart += np.bitwise_count((p[a] ^ p[b]).view(np.uint64))
            near = 9 * apart <= n[a] + n[b]
            a, b, apart = a[near], b[near], apart[near]
        a, b = entry[a], entry[b]
        return np.minimum(a, b), np.maximum(a, b)

    def pairs(columns: list[np.ndarray], last: bool):
        edges = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0), True])
        if not last:
            edges = edges[:-1]
        out = [got for begin, end in zip(edges[:-1], edges[1:], strict=True) if end - begin > 1 and (got := settle([c[begin:end] for c in columns]))]
        found = np.unique(np.concatenate([np.stack(p, 1) for p in out]), axis=0) if out else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"]), [c[edges[-1] :] for c in columns]

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy().astype(np.int64) for c in batch.columns]
        held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
        if len(held[0]) >= 8 * BLOCK:
            found, held = pairs(held, False)
            yield found
    if held is not None and len(held[0]):
        yield pairs(held, True)[0]


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of independent hashes of words."""
    x = x.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _buckets(batches):
    """(key, entry) sorted by both -> (c, x0, x1, part, key, entries) of keys of several entries, repeats left out.

    ``c``, ``x0`` and ``x1`` are the number and two hashes of all entries of the key; a row has up to ``BLOCK`` of them.
    """
    import pyarrow as pa

    def settle(keys: np.ndarray, entries: np.ndarray):
        new = np.r_[True, (keys[1:] != keys[:-1]) | (entries[1:] != entries[:-1])]
        keys, entries = keys[new], entries[new]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        several = np.repeat(sizes > 1, sizes)
        keys, entries, sizes = keys[several], entries[several], sizes[sizes > 1]
        if not len(sizes):
            return
        starts, parts = np.cumsum(sizes) - sizes, -(-sizes // BLOCK)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(starts, parts) + BLOCK * part
        sets = [np.bitwise_xor.reduceat(_mixed(entries, k), starts).view(np.int64) for k in (0, 1)]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(entries)], pa.int32()), pa.array(entries))
        columns = [*(pa.array(np.repeat(x, parts)) for x in (sizes, *sets)), pa.array(part, pa.int32()), pa.array(keys[cuts]), lists]
        yield pa.RecordBatch.from_arrays(columns, ["c", "x0", "x1", "part", "key", "entries"])

    keys, entries = np.empty(0, np.int64), np.empty(0, np.int64)
    held, total = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        total += batch.num_rows
        if total > 1 << 17:
            keys, entries = (np.concatenate([x, *y]) for x, y in zip((keys, entries), zip(*held, strict=True), strict=True))
            held, total = [], 0
            if cut := int(np.searchsorted(keys, keys[-1])):  # the last key may go on
                yield from settle(keys[:cut], entries[:cut])
                keys, entries = keys[cut:], entries[cut:]
    if held:
        keys, entries = (np.concatenate([x, *y]) for x, y in zip((keys, entries), zip(*held, strict=True), strict=True))
    if len(keys):
        yield from settle(keys, entries)


def _few(df: DataFrame) -> DataFrame:
    """``df``, which is written, to be broadcast where its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _verified(pairs: DataFrame, docs: DataFrame, entries: DataFrame, text_col: str) -> DataFrame:
    """Those of the distinct candidate pairs that are similar."""
    pairs = durable(pairs)
    if pairs.isEmpty():
        return pairs
    # the ends' sketches are taken out once, as all entries would move for each end
    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("entry")).distinct())
    known = durable(entries.select("entry", "_key", "n", "sketch").join(_few(nodes), "entry", "left_semi"))
    ends = [known.select(F.col("entry").alias(x), F.col("n").alias(n), F.col("sketch").alias(side)) for x, n, side in (("a", "n", "left"), ("b", "m", "right"))]
    pairs = durable(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "n", "m", "left", "right").mapInArrow(_plausible, "a long, b long"))
    nodes = pairs.select(F.col("a").alias("entry")).union(pairs.select(F.col("b").alias("entry"))).distinct()
    wanted = durable(nodes.join(known.select("entry", "_key"), "entry").select("_key").distinct())
    texts = docs.select(text_key(F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("text")).join(_few(wanted), "_key", "left_semi").select("text")
    # one exchange of the sets serves both joins
    sets = texts.mapInArrow(_sets, "entry long, packed binary").groupBy("entry").agg(F.first("packed").alias("packed"))
    left, right = (sets.select(F.col("entry").alias(name), F.col("packed").alias(side)) for name, side in (("a", "left"), ("b", "right")))
    return durable(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long"))


def link_entries(entries: DataFrame, prefixes: DataFrame, docs: DataFrame, text_col: str, block: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """(node, component) of every entry that has a near copy; ``entries``: entry, _key, n, sketch, parities; ``prefixes``: key, entry; ``links``: (a, b) known before."""
    block = block or BLOCK
    # two hashes and the number of entries tell the set; the prefixes, most of which meet nothing, move once
    dealt = prefixes.select("key", "entry").repartition("key").sortWithinPartitions("key", "entry")
    buckets = dealt.mapInArrow(_buckets, "c long, x0 long, x1 long, part int, key long, entries array<long>")
    alike = buckets.groupBy("c", "x0", "x1", "part").agg(F.min("key").alias("key"), F.count("*").alias("weight"), F.first("entries").alias("entries"))
    shared = durable(alike.select("key", "weight", F.ceil(F.col("c") / block).cast("int").alias("blocks"), F.explode("entries").alias("entry")))

    def apart(groups: DataFrame | None) -> DataFrame:
        """Rows of the buckets that span several components, with the component as root."""
        if groups is None:
            return shared.withColumn("root", F.col("entry"))
        rows = shared.join(groups, F.col("entry") == F.col("node"), "left").withColumn("root", F.coalesce("component", "entry")).drop("node", "component")
        several = durable(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"))
        return durable(rows.join(_few(several), "key"))

    groups = None if links is None else durable(connected_components(links))
    for turn in range(ROUNDS):
        order = F.struct("n", "entry") if turn == 0 else F.struct(F.xxhash64("entry", F.lit(turn)), "entry")
        rows = apart(groups).join(entries.select("entry", "n"), "entry").withColumn("block", F.pmod(F.xxhash64("entry", F.lit(50 + turn)), F.col("blocks")))
        near = rows.withColumn("other", F.lag(F.struct("entry", "n", "root")).over(Window.partitionBy("key", "block").orderBy(order)))
        may = near.where("other.root != root and 5 * least(n, other.n) >= 4 * greatest(n, other.n)")
        met = may.groupBy(F.least("entry", "other.entry").alias("a"), F.greatest("entry", "other.entry").alias("b")).agg(F.sum("weight").alias("times"))
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))).where(F.col("rank") <= NEAREST)
        found = _verified(best.select("a", "b"), docs, entries, text_col)
        if found.isEmpty() and links is not None:
            continue
        links = found if links is None else links.unionByName(found)
        groups = durable(connected_components(links))
    rest = apart(groups).join(entries.select("entry", "n", *PARITY), "entry")
    cut = rest.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(5)), F.col("blocks")).cast("int"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    sides = met.select("key", "i", "j", "block", "n", "entry", "root", *PARITY).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = _verified(sides.mapInArrow(_block_pairs, "a long, b long").distinct(), docs, entries, text_col)
    return groups if found.isEmpty() else connected_components(links.unionByName(found))


def _common(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that are common in a sample: from the least count on that ``MOST_COMMON`` at most reach."""
    counted = durable(sample.mapInArrow(_shingles, "key long").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON))
    least, total = COMMON, 0
    for r in sorted(counted.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.c):
        total += r.n
        if total > MOST_COMMON:
            least = r.c + 1
            break
    found = counted.where(F.col("c") >= least).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("c").to_numpy()[order]


def _simhash_links(marked: DataFrame) -> DataFrame | None:
    """(a, b) links that join the entries whose fingerprints are in one group; None if there are none."""
    fps = durable(marked.groupBy("fp").agg(F.min("entry").alias("first")))
    rooted = durable(fingerprint_roots(fps))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("b")), "root").select("fp", "b")
    links = durable(marked.select("fp", F.col("entry").alias("a")).distinct().join(named, "fp").where("a != b").select("a", "b").distinct())
    return None if links.isEmpty() else links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """(_id, _key, root) of every document; ``root`` is one for each group of near copies."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    part = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(max(1, texts.count() // SAMPLE))) == 0
    common, counts = _common(texts.where(part))
    kind = docs.schema[id_col].dataType.simpleString()
    order = _marked(common, counts)
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(order, f"_id {kind}, _key long, fp long, entry long, n int, prefix array<long>, sketch binary, " + ", ".join(f"{p} long" for p in PARITY))
    marked = durable(made.withColumn("uid", F.monotonically_increasing_id()))
    # one row stands for all of an entry
    several = durable(marked.groupBy("entry").agg(F.min("uid").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    stands = marked.join(_few(several), "entry", "left").where("first is null or uid = first")
    entries = durable(stands.select("entry", "_key", "n", "sketch", *PARITY))
    groups = link_entries(entries, stands.select(F.explode("prefix").alias("key"), "entry"), docs, text_col, block, _simhash_links(marked))
    return marked.select("_id", "_key", "entry").join(groups, F.col("entry") == F.col("node"), "left").select("_id", "_key", F.coalesce("component", "entry").alias("root"))
