"""Language-model scoring by stupid back-off, as joins of blocks of n-grams with count tables.

Words are runs of other than ASCII white space with A-Z lower-cased; a text is padded at its front.
A count table for each length k up to the order holds the k-grams of the whole corpus, keyed by
hashes; none is left out. A word is scored by what the rest of the corpus says: its own
occurrence is taken from every count. So a k-gram that occurs ``MIN_COUNT`` times or more elsewhere
scores count over count of its context (the k - 1 words before; of the padding alone: the texts);
another scores ``BACKOFF`` times its shorter gram; a word alone its count over all words, and
``BACKOFF`` over all words where it occurs nowhere else. The score of a document is the mean
logarithm over its words.

The relations are kept as runs, not as one row per n-gram, which would be several times the text:

1. documents become blocks of about ``BLOCK_WORDS`` words, written to the checkpoint folder;
2. each block explodes its n-grams, counts them (so a hot n-gram is one entry of a block) and deals
   the sorted hashes to hash ranges: one row per block, table and range, hashes as coded gaps;
3. the rows of one range meet, and their sums are that range of the count table, which is joined to
   the n-grams of every block at once: each row's hashes become the counts over the corpus;
4. these rows meet their block again, where the scores of its n-grams are summed per document.

A range holds about ``RANGE_ENTRIES`` entries at any size of corpus. A block is dealt to at most
``2 ** STEP_BITS`` ranges of a table. Where more are needed, the rows of as many blocks as there
are ranges are first merged, range by range, into runs that are as long as a block's and are dealt
on to finer ranges; the counts come back the same way. So the rows grow in proportion to the words.

Hashes have ``SPARE_BITS`` more bits than it takes to number the words of the corpus, up to 64:
about one n-gram in ``2 ** SPARE_BITS`` shares its hash, and so its count, with another.

Defined results: null texts and texts without a word have no words and a null score; repeated rows
are scored one by one; null ids are carried along; an empty table gives an empty result; other
columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import durable

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
#: Words of a block (a longer text is a block of its own) and entries of a hash range, in expectation.
BLOCK_WORDS, RANGE_ENTRIES = 1 << 21, 1_000_000
#: Ranges of a table that one row set is dealt to at a time, as a power of two.
STEP_BITS = 10
#: Bits of a hash beyond those that number the corpus' words.
SPARE_BITS = 24
#: Words whose hashes a Python worker remembers.
REMEMBERED = 1_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


class _Hashes(dict):
    """Word -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_known = _Hashes()


def known_hashes() -> _Hashes:
    """The hashes this Python worker remembers, from task to task."""
    return _known


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    words = text.lower().split()  # bytes: ASCII letters and white space only
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, compressed byte plane by byte plane."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _gapped(run: np.ndarray) -> np.ndarray:
    return np.diff(run, prepend=np.zeros(1, np.uint64))


def grams(hashes: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The key of the k-gram that ends at each word, for k = 1 .. order, of texts laid end to end."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    padding, last = np.uint64(0), hashes
    yield last
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            before = _shifted(last, starts, padding)
            # another function of each length, so that no table's keys follow from another's
            last = _mixed(_mixed(before + _MIX[2] * np.uint64(k)) * _MIX[2] + hashes)
            yield last
            padding = _mixed(np.full(1, padding + _MIX[2] * np.uint64(k)))[0]


def _shifted(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """Each word's predecessor's value; ``first`` at the beginnings of texts."""
    out = np.concatenate([values[:1], values[:-1]])
    out[starts] = first
    return out


def _decoded(vocabulary: bytes, codes: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(vocabulary), dtype=np.uint64)[_unpacked(codes).astype(np.int64)], _unpacked(sizes).astype(np.int64)


def _blocks(block_words: int):
    """Rows of (id, text) -> blocks: ids, words of each text, and the texts' word hashes as codes of a vocabulary."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, number = known_hashes(), TaskContext.get().partitionId() << 32
        ids, held, total = [], [], 0

        def block():
            nonlocal ids, held, total, number
            vocabulary, codes, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            # frequent words get small codes; inside a class of frequencies the hashes stay sorted
            turn = np.lexsort((vocabulary, -np.frexp(counts)[1]))
            place = np.empty(len(turn), np.int64)
            place[turn] = np.arange(len(turn))
            vocabulary, codes = vocabulary[turn], place[codes]
            values = pa.concat_arrays(ids)
            row = [
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([total]), pa.array([sum(len(h) > 0 for h in held)]), pa.array([_packed(np.array([len(h) for h in held], np.uint64))], pa.binary()),
                pa.array([_packed(_gapped(vocabulary))], pa.binary()), pa.array([_packed(codes.astype(np.uint64))], pa.binary()),
            ]
            ids, held, total, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "words", "texts", "sizes", "vocabulary", "codes"])

        for batch in batches:
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids.append(batch.column(0).slice(i, 1))
                held.append(word_hashes(text.as_py() or b"", known))
                total += len(held[-1])
                if total >= block_words or len(held) >= block_words // 16:
                    yield block()
        if held:
            yield block()

    return run


def _cut(runs: np.ndarray, table: int, have: int, bits: int, width: int) -> list[tuple[int, slice]]:
    """(cell, part) of a sorted run of keys of ``width`` bits that share ``have``; a cell is the table and the first ``bits``."""
    if not len(runs):
        return []
    prefix = int(runs[0]) >> (width - have) if have else 0
    firsts = (prefix << (bits - have)) + np.arange(1 << (bits - have), dtype=np.uint64)
    cuts = np.r_[np.searchsorted(runs, firsts << np.uint64(width - bits)) if bits else [0], len(runs)]
    return [((table << 48) + int(firsts[r]), slice(cuts[r], cuts[r + 1])) for r in np.flatnonzero(np.diff(cuts)).tolist()]


def _rows(source: int, runs: np.ndarray, counts: np.ndarray, parts: list[tuple[int, slice]]):
    import pyarrow as pa

    columns = [
        pa.array([source] * len(parts), pa.int64()), pa.array([c for c, _ in parts], pa.int64()),
        pa.array([_packed(_gapped(runs[s])) for _, s in parts], pa.binary()), pa.array([_packed(counts[s]) for _, s in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["source", "cell", "keys", "counts"])


def _dealt(order: int, bits: int, width: int):
    """Blocks -> (source, cell, keys, counts): sorted runs of distinct keys."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes, sizes = _decoded(row["vocabulary"], row["codes"], row["sizes"])
                for table, keys in enumerate(grams(hashes, sizes, order), 1):
                    runs, counts = np.unique(keys >> np.uint64(64 - width), return_counts=True)
                    yield _rows(row["block"], runs, counts, _cut(runs, table, 0, bits, width))

    return run


def _united(table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, their summed counts, each row's places among them) of rows of one cell."""
    runs = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
    merged, at = np.unique(np.concatenate(runs), return_inverse=True)
    totals = np.zeros(len(merged), np.uint64)
    np.add.at(totals, at, counts)
    return merged, totals, np.split(at, np.cumsum([len(r) for r in runs])[:-1])


def _summed(table):
    """The rows of one cell, with the counts of their keys over all of them in place of their own."""
    import pyarrow as pa

    _, totals, places = _united(table)
    return pa.table({"source": table.column("source"), "cell": table.column("cell"), "seen": pa.array([_packed(totals[p]) for p in places], pa.binary())})


def _merged(table):
    """Rows of one cell as one run, and what leads back from it to the rows."""
    import pyarrow as pa

    runs, totals, places = _united(table)
    members = [{"source": s, "places": _packed(_gapped(p.astype(np.uint64)))} for s, p in zip(table.column("source").to_pylist(), places, strict=True)]
    kind = pa.list_(pa.struct([("source", pa.int64()), ("places", pa.binary())]))
    return pa.table({"cell": table.column("cell").slice(0, 1), "keys": [_packed(_gapped(runs))], "counts": [_packed(totals)], "members": pa.array([members], kind)})


def _finer(have: int, bits: int, width: int):
    """Merged runs -> rows of finer cells."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                runs = np.cumsum(_unpacked(row["keys"]), dtype=np.uint64)
                yield _rows(row["node"], runs, _unpacked(row["counts"]), _cut(runs, row["cell"] >> 48, have, bits, width))

    return run


def _returned(node, replies):
    """A merged run and the counts of its keys -> the counts of each of its rows."""
    import pyarrow as pa

    parts = sorted(zip(replies.column("cell").to_pylist(), replies.column("seen").to_pylist(), strict=True))
    seen = np.concatenate([_unpacked(s) for _, s in parts])
    (row,) = node.to_pylist()
    back = [_packed(seen[np.cumsum(_unpacked(m["places"]), dtype=np.uint64).astype(np.int64)]) for m in row["members"]]
    return pa.table({"source": pa.array([m["source"] for m in row["members"]], pa.int64()), "cell": pa.array([row["cell"]] * len(back), pa.int64()), "seen": pa.array(back, pa.binary())})


def _counted(rows: DataFrame, sources: int, steps: list[int], width: int, before: int = 0) -> DataFrame:
    """(source, cell, seen) of (source, cell, keys, counts): counts of the keys over all rows.

    ``steps``: the bits of a cell at each step; the rows' cells are those of the first. ``sources``
    is the number of rows of a cell, at most.
    """
    kind = "source long, cell long, seen binary"
    if len(steps) == 1:
        return rows.groupBy("cell").applyInArrow(_summed, kind)
    bundles = -(-sources // (1 << (steps[0] - before)))
    bundled = rows.withColumn("bundle", F.pmod(F.xxhash64("source"), F.lit(bundles)))
    merged = bundled.groupBy("cell", "bundle").applyInArrow(_merged, "cell long, keys binary, counts binary, members array<struct<source:long,places:binary>>")
    nodes = durable(merged.withColumn("node", F.monotonically_increasing_id()))
    finer = nodes.select("node", "cell", "keys", "counts").mapInArrow(_finer(*steps[:2], width), "source long, cell long, keys binary, counts binary")
    replies = _counted(finer, bundles, steps[1:], width, steps[0])
    return nodes.select("node", "cell", "members").groupBy("node").cogroup(replies.groupBy("source")).applyInArrow(_returned, kind)


def _scored(order: int, min_count: int, backoff: float, total: int, texts: int, width: int):
    """A block and the counts of its keys -> (_id, n_words, score) of its documents."""

    def run(block, replies):
        import pyarrow as pa

        (row,) = block.drop_columns(["ids"]).to_pylist()
        hashes, sizes = _decoded(row["vocabulary"], row["codes"], row["sizes"])
        cells: dict[int, list] = {}
        for cell, seen in sorted(zip(replies.column("cell").to_pylist(), replies.column("seen").to_pylist(), strict=True)):
            cells.setdefault(cell >> 48, []).append(_unpacked(seen))
        full = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[full]
        score, context = np.full(len(hashes), np.log10(1 / total)), np.full(len(hashes), total, np.float64)
        for k, keys in enumerate(grams(hashes, sizes, order), 1):
            runs, at = np.unique(keys >> np.uint64(64 - width), return_inverse=True)
            counts = np.concatenate(cells[k]) if k in cells else np.zeros(0, np.uint64)
            if len(counts) != len(runs):
                raise ValueError(f"block {row['block']}, {k}-grams: {len(counts)} counts for {len(runs)} keys")
            seen = counts[at].astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(seen > min_count, np.log10((seen - 1) / (context - 1)), np.log10(backoff) + score)
            context = _shifted(seen, starts, texts)
        means = np.zeros(len(sizes))
        if full.any():
            means[full] = np.add.reduceat(score, starts) / sizes[full]
        ids = pa.concat_arrays([c.flatten() for c in block.column("ids").chunks])
        return pa.table({"_id": ids, "n_words": pa.array(sizes), "score": pa.array(means, mask=~full)})

    return run


def score_documents(
    docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text",
    block_words: int = BLOCK_WORDS, range_entries: int = RANGE_ENTRIES, step_bits: int = STEP_BITS,
) -> DataFrame:
    """(id, n_words, score) of each row; score is the mean logarithm to base 10 over its words."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = durable(rows.mapInArrow(_blocks(block_words), f"block long, ids array<{kind}>, words long, texts long, sizes binary, vocabulary binary, codes binary"))
    found = blocks.agg(F.sum("words").alias("words"), F.sum("texts").alias("texts"), F.count("*").alias("blocks")).first()
    total = max(1, found.words or 0)
    bits = (total // range_entries).bit_length()
    width = min(64, total.bit_length() + SPARE_BITS)
    parts = max(1, -(-bits // step_bits))
    steps = [-(-bits * (i + 1) // parts) for i in range(parts)]
    dealt = blocks.select("block", "sizes", "vocabulary", "codes").mapInArrow(_dealt(order, steps[0], width), "source long, cell long, keys binary, counts binary")
    replies = _counted(dealt, found.blocks, steps, width)
    scored = blocks.groupBy("block").cogroup(replies.groupBy("source")).applyInArrow(_scored(order, min_count, backoff, total, found.texts or 0, width), f"_id {kind}, n_words long, score double")
    return scored.withColumnRenamed("_id", id_col)
