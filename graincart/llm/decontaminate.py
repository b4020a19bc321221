"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items meet in seeds: windows of ``SEED_WORDS`` words (an item of
fewer words is one window of its own size) under a Karp-Rabin hash.

1. Documents are scanned where they are, against two bitmaps of the benchmark's words and seeds. The
   bitmaps have a fixed size at most (``FILTER_BITS``), whatever the benchmark's: they let through all
   that matters and little else. What a text with seeds yields is one row for its digest, with the
   words round its seeds; equal texts are one row.
2. An equi-join on the seeds' hashes gives the pairs of text and item that share a seed.
3. Each pair is tiled: the longest match that overlaps nothing marked is marked, again and again,
   until none of ``SEED_WORDS`` words is left. The longest length is found by bisection over
   Karp-Rabin hashes of all free windows, so repeated words cost no more than others. Of equally long
   matches the one first in the item, then first in the document, goes first.
4. Marked words over the item's words is its coverage, so a passage in another order counts as much
   as one in order. A document whose best item reaches ``COVERAGE`` is contaminated. The verdicts go
   back to the rows by the digest: by a broadcast up to ``BROADCAST_BYTES``, else by a shuffle.

Words are compared by 64-bit hashes. The benchmark never reaches the driver.

Defined results: null and empty texts, and an empty benchmark, give coverage 0 and no item; items
with a null id, null text or no word never match; an item of fewer words than a seed matches whole or
not at all; of equal coverage the smallest item id wins; several rows of one item id are items of
their own; repeated rows are judged one by one; an empty table gives an empty result; result columns
replace columns of the same name, and all others are kept, of any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, durable

SEED_WORDS, COVERAGE = 5, 0.5
#: The most bits of a bitmap, as a power of two; verdicts that are broadcast, in bytes; words a Python worker remembers.
FILTER_BITS, BROADCAST_BYTES, REMEMBERED = 27, 64 << 20, 1_000_000
_word = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    """A word's number, never 0."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


class Windows:
    """Karp-Rabin hashes of all windows of a length, for any length, over one sequence of numbers."""

    def __init__(self, tokens: np.ndarray) -> None:
        powers = np.full(len(tokens), _BASE, np.uint64)
        powers[:1] = 1
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(tokens * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)]
        back = np.full(len(tokens), _UNBASE, np.uint64)
        back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def of(self, size: int) -> np.ndarray:
        n = max(0, len(self.back) - size + 1)
        x = (self.sums[size : size + n] - self.sums[:n]) * self.back[:n]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def tiles(item: np.ndarray, doc: np.ndarray, size: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in document, words), longest first; a document word 0 matches nothing."""
    at_item, at_doc = Windows(item), Windows(doc)
    item_free, doc_free, out = np.ones(len(item), bool), doc != 0, []

    def free(mask: np.ndarray, n: int) -> np.ndarray:
        taken = np.r_[0, np.cumsum(~mask)]
        return np.flatnonzero(taken[n:] == taken[:-n])

    def met(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of n words that both have: places in the item and their hashes, places in the document and theirs."""
        a, b = free(item_free, n), free(doc_free, n)
        x, y = at_item.of(n)[a], at_doc.of(n)[b]
        left, right = np.isin(x, y), np.isin(y, x)
        return a[left], x[left], b[right], y[right]

    longest = min(len(item), len(doc))
    while longest >= size and len((found := met(size))[0]):
        low, high = size, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len((some := met(middle))[0]):
                low, found = middle, some
            else:
                high = middle - 1
        a, x, b, y = found
        order = np.lexsort((b, y))
        b, y = b[order], y[order]
        nexts = np.searchsorted(y, x)
        ends = np.searchsorted(y, x, "right")
        passed: dict[int, int] = {}  # places of a hash that are known to be taken
        for p, h, first, end in zip(a.tolist(), x.tolist(), nexts.tolist(), ends.tolist(), strict=True):
            if not item_free[p : p + low].all():
                continue
            k = max(first, passed.get(h, 0))
            while k < end and not doc_free[b[k] : b[k] + low].all():
                k += 1
            passed[h] = k
            if k < end and (item[p : p + low] == doc[b[k] : b[k] + low]).all():
                item_free[p : p + low] = doc_free[b[k] : b[k] + low] = False
                out.append((p, int(b[k]), low))
        longest = low - 1
    return out


class Filter:
    """Bitmaps of the benchmark's words and seeds, and what a text shares with them."""

    def __init__(self, words: np.ndarray, seeds: np.ndarray, sizes: list[int]) -> None:
        self.words, self.seeds, self.sizes = words, seeds, sizes
        self._known: dict[str, int] = {}

    def __getstate__(self):
        return self.words, self.seeds, self.sizes

    def __setstate__(self, state):
        (self.words, self.seeds, self.sizes), self._known = state, {}

    def _number(self, word: str) -> int:
        """A word's number, or 0 if no item holds it."""
        found = word_hash(word)
        slot = found & (64 * len(self.words) - 1)
        return found if int(self.words[slot >> 6]) >> (slot & 63) & 1 else 0

    def shared(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(places, words, distinct seeds) of the parts of a text that hold seeds; a 0 parts them. None if there are none."""
        found = words_of(text)
        if not found or not self.sizes:
            return None
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for w in {w for w in found if w not in known}:
            known[w] = self._number(w)
        tokens = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        bad = np.r_[0, np.cumsum(tokens == 0)]
        if bad[-1] > len(tokens) - min(self.sizes):
            return None
        cover, seeds = np.zeros(len(tokens) + 1, np.int64), []
        mask, windows = np.uint64(64 * len(self.seeds) - 1), None
        for size in self.sizes:
            at = np.flatnonzero(bad[size:] == bad[:-size]) if len(tokens) >= size else []
            if not len(at):
                continue
            windows = windows or Windows(tokens)
            hashes = windows.of(size)[at]
            slots = hashes & mask
            good = (self.seeds[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
            at, hashes = at[good], hashes[good]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            seeds.append(hashes)
        if not sum(map(len, seeds)):
            return None
        held = np.flatnonzero(np.cumsum(cover[:-1]))
        gaps = np.flatnonzero(np.diff(held) > 1) + 1
        return np.insert(held, gaps, -1), np.insert(tokens[held], gaps, np.uint64(0)), np.unique(np.concatenate(seeds))


def _items(size: int):
    """(id, text) -> (item, tokens, size of its windows, their hashes, its distinct words) of items that can match."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.array([word_hash(w) for w in words_of(text)], np.uint64)
                if len(tokens):
                    n = min(size, len(tokens))
                    rows.append((i, tokens.tobytes(), n, np.unique(Windows(tokens).of(n)).view(np.int64), np.unique(tokens).view(np.int64)))
            at, tokens, sizes, seeds, words = zip(*rows, strict=True) if rows else ((),) * 5
            kind = pa.list_(pa.int64())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, pa.binary()), pa.array(sizes, pa.int32()), pa.array(seeds, kind), pa.array(words, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "tokens", "size", "seeds", "words"])

    return run


def _bitmap(numbers: DataFrame, count: int) -> np.ndarray:
    """The bitmap of a column ``x`` of longs; its size follows ``count`` up to a fixed bound, and only it reaches the driver."""
    bits = min(FILTER_BITS, max(12, (16 * count).bit_length()))
    slot = F.col("x").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    lanes = numbers.select(F.shiftright(slot, 6).alias("lane"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit")).groupBy("lane").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = lanes.toPandas()
    out[found["lane"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _scan(shared):
    """Texts -> (digest, places, tokens, seeds) of those that hold seeds."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if (found := shared.value.shared(text)) is not None:
                    places, tokens, seeds = found
                    rows.append((hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), places.astype("<i4").tobytes(), tokens.tobytes(), seeds.view(np.int64)))
            digest, places, tokens, seeds = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [pa.array(digest, pa.string()), pa.array(places, pa.binary()), pa.array(tokens, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "places", "doc", "seeds"])

    return run


def _tiled(batches: Iterator):
    """(digest, places, doc, item, tokens, size) -> (digest, missing, item, tiles); missing: 1 less the coverage."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))
    for batch in batches:
        missing, all_tiles = [], []
        for places, doc, tokens, size in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5)), strict=True):
            item, where = np.frombuffer(tokens, np.uint64), np.frombuffer(places, "<i4")
            got = tiles(item, np.frombuffer(doc, np.uint64), size)
            missing.append(1 - sum(n for _, _, n in got) / len(item))
            all_tiles.append([{"item_word": a, "doc_word": int(where[b]), "words": n} for a, b, n in got])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(missing, pa.float64()), batch.column(3), pa.array(all_tiles, kind)], ["digest", "missing", "item", "tiles"])


_TILES = "array<struct<item_word:int,doc_word:int,words:int>>"


def verdicts(texts: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """(digest, item, coverage, tiles) of the distinct texts that share a seed with an item; ``texts``: one column; ``benchmark``: item, text."""
    kind = benchmark.schema[benchmark.columns[0]].dataType.simpleString()
    known = benchmark.toDF("item", "text").where("item is not null and text is not null")
    made = known.mapInArrow(_items(seed_words), f"item {kind}, tokens binary, size int, seeds array<long>, words array<long>")
    items = durable(made.withColumn("row", F.monotonically_increasing_id()))
    counts = items.agg(F.sum(F.size("seeds")).alias("seeds"), F.sum(F.size("words")).alias("words"), F.collect_set("size").alias("sizes")).first()
    maps = [_bitmap(items.select(F.explode(c).alias("x")), counts[c] or 0) for c in ("words", "seeds")]
    shared = texts.sparkSession.sparkContext.broadcast(Filter(*maps, sorted(counts.sizes)))
    found = texts.mapInArrow(_scan(shared), "digest string, places binary, doc binary, seeds array<long>")
    found = durable(found.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("places", "doc", "seeds"))))
    met = found.select("digest", F.explode("seeds").alias("seed")).join(items.select("row", F.explode("seeds").alias("seed")), "seed").select("digest", "row").distinct()
    pairs = met.join(found.drop("seeds"), "digest").join(items.select("row", "item", "tokens", "size"), "row")
    judged = pairs.select("digest", "places", "doc", "item", "tokens", "size").mapInArrow(_tiled, f"digest string, missing double, item {kind}, tiles {_TILES}")
    # the least of (missing, item): best coverage, then smallest id
    best = judged.groupBy("digest").agg(F.min(F.struct("missing", "item", "tiles")).alias("best"))
    return durable(best.where("best.missing < 1").select("digest", F.col("best.item").alias("item"), (1 - F.col("best.missing")).alias("coverage"), F.col("best.tiles").alias("tiles")))


def judge(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with contaminated, item_id, coverage, and tiles (place in item, in document, words) of the best item."""
    found = verdicts(docs.select(F.col(text_col).cast("string")), benchmark.select(F.col(item_col), F.col(item_text_col)))
    size = found.agg(F.sum(F.size("tiles") * 12 + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    # a null text meets nothing; its key differs from row to row, lest all of them land in one task
    digest = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    rows = docs.select(boxed(docs, "contaminated", "item_id", "coverage", "tiles"), digest.alias("digest"))
    met = rows.join(found, "digest", "left")
    part = F.coalesce("coverage", F.lit(0.0))
    return met.select("row.*", F.col("item").alias("item_id"), part.alias("coverage"), (part >= coverage).alias("contaminated"), F.coalesce("tiles", F.array().cast(_TILES)).alias("tiles"))
