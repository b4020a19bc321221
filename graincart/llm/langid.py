"""Language identification by prediction by partial matching over bytes.

For each language a variable-order byte context tree (contexts of 0 to ``ORDER`` bytes) is counted
on a bounded sample and frozen. The cost of a byte in its context is exact: the longest context of
the tree gives ``count / (total + distinct)`` if it has seen the byte, else the escape probability
``distinct / (total + distinct)`` and the next shorter context; below the empty context all 256
bytes are alike. The language with the shortest code for the whole text wins.

Since the statistics are frozen, the cost depends on the byte and the bytes before it alone. A tree is
kept sparse, as sorted arrays of what was seen with its cost, and contexts with the cost of their
escape. The exact costs of windows of ``ORDER`` + 1 bytes are computed for many windows at once, and
those met lately are remembered in a table of fixed size, so a text is scored by array look-ups,
without a loop over bytes, and memory does not grow with languages times contexts.

Defined results: null texts and texts without a letter give ``und`` and score 0; ties go to the
language that sorts first; repeated rows are scored one by one, and a score does not depend on the
rows around it; an empty table gives an empty result; with no labelled rows all is ``und``; the
result columns replace columns of the same name, and all others are kept, of any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, kept

#: Bytes of context, and the bound of the sample: UTF-8 bytes of a language, in expectation.
ORDER, SAMPLE_BYTES = 3, 3_000_000
_letter = re.compile(r"[^\W\d_]")
#: Texts are counted and scored together up to so many bytes; bytes of the table of costs met lately.
_BLOCK, _TABLE_BYTES = 1 << 20, 1 << 25
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _gram_counts(order: int):
    """(lang, n, gram, count) of the byte grams of n = 1 .. order + 1, summed over each task's rows."""

    def flush(pa, held):
        for lang, texts in held.items():
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            place = np.arange(len(data)) - np.repeat(ends - [len(t) for t in texts], [len(t) for t in texts])
            gram = np.zeros(len(data), np.uint64)
            for n in range(1, order + 2):
                gram[n - 1 :] |= data[: len(data) - n + 1].astype(np.uint64) << np.uint64(8 * (n - 1))
                grams, counts = np.unique(gram[place >= n - 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array([n] * len(grams), pa.int32()), pa.array(grams.astype(np.int64)), pa.array(counts, pa.int64())], ["lang", "n", "gram", "count"])

    def run(batches):
        import pyarrow as pa

        kept("language ID")
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text.encode())
                size += len(held[lang][-1])
                if size > _BLOCK:
                    yield from flush(pa, held)
                    held, size = {}, 0
        yield from flush(pa, held)

    return run


class Tree:
    """One language's context tree: for each window length, the windows seen and their cost in bits, and the contexts' escapes."""

    def __init__(self, n: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int) -> None:
        self.levels = []
        for length in range(order + 1, 0, -1):
            at = n == length
            turn = np.argsort(gram[at], kind="stable")
            grams, counts = gram[at][turn], count[at][turn].astype(np.float64)
            contexts, first = np.unique(grams >> 8, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.empty(0)
            kinds = np.diff(np.r_[first, len(grams)])
            cost = np.log2(np.repeat(totals + kinds, kinds) / counts)
            self.levels.append((length, grams, cost, contexts, np.log2((totals + kinds) / kinds)))

    def costs(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window, which holds ``lengths`` bytes."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for length, grams, cost, contexts, escape in self.levels:
            if not len(grams):
                continue
            mine = left[lengths[left] >= length]
            window = windows[mine] & ((1 << (8 * length)) - 1)
            place = np.minimum(np.searchsorted(grams, window), len(grams) - 1)
            seen = grams[place] == window
            out[mine[seen]] += cost[place[seen]]
            missed, above = mine[~seen], window[~seen] >> 8
            place = np.minimum(np.searchsorted(contexts, above), len(contexts) - 1)
            known = contexts[place] == above
            out[missed[known]] += escape[place[known]]
            left = np.concatenate([left[lengths[left] < length], missed])
        out[left] += 8.0  # below the empty context all bytes are alike
        return out


class PpmModel:
    """Frozen statistics: for each language, window length and window, a count."""

    def __init__(self, langs: list[str], lang: np.ndarray, n: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int = ORDER) -> None:
        if order > 6:
            raise ValueError("windows of more than 7 bytes do not fit a number")
        self.langs, self.order = langs, order
        self.lang, self.n, self.gram, self.count = lang.astype(np.int16), n.astype(np.int8), gram, count
        self._trees: list[Tree] = []

    def __getstate__(self):
        return self.langs, self.order, self.lang, self.n, self.gram, self.count

    def __setstate__(self, state):
        (self.langs, self.order, self.lang, self.n, self.gram, self.count), self._trees = state, []

    def _ready(self) -> None:
        if not self._trees:
            of = [self.lang == k for k in range(len(self.langs))]
            self._trees = [Tree(self.n[m], self.gram[m], self.count[m], self.order) for m in of]
            self._bits = min(20, max(8, (_TABLE_BYTES // (4 * len(self.langs))).bit_length() - 1))
            self._keys = np.full(1 << self._bits, -1, np.int64)  # window and length of the cost in each slot
            self._costs = np.zeros((len(self.langs), 1 << self._bits), np.float32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text, none of them empty, in each language's model: an array of texts by languages."""
        self._ready()
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        keys, width = data.astype(np.int64), self.order + 1  # in place, as a block's arrays take most of the memory
        for back in range(1, min(width, len(data))):
            keys[back:] |= data[:-back].astype(np.int64) << (8 * back)
        keys |= np.int64(width) << 56
        for back in range(min(width - 1, int(sizes.max(initial=0)))):  # at a text's begin the window is shorter
            at = starts[sizes > back] + back
            keys[at] = (keys[at] & ((1 << (8 * (back + 1))) - 1)) | ((back + 1) << 56)
        hashes = keys.view(np.uint64) * _HASH
        hashes >>= np.uint64(64 - self._bits)
        slots = hashes.view(np.int64)
        missed = np.flatnonzero(self._keys[slots] != keys)
        late = np.empty(0, np.int64)
        if len(missed):
            new, which = np.unique(keys[missed], return_inverse=True)
            costs = np.stack([t.costs(new & ((1 << 56) - 1), new >> 56) for t in self._trees]).astype(np.float32)
            place = np.empty(len(new), np.int64)
            place[which] = slots[missed]
            self._keys[place], self._costs[:, place] = new, costs  # of two windows for one slot the last stays
            late = np.flatnonzero(self._keys[slots[missed]] != keys[missed])
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            cost = self._costs[k][slots]
            if len(late):
                cost[missed[late]] = costs[k][which[late]]
            out[:, k] = np.add.reduceat(cost, starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        usable = [i for i, t in enumerate(texts) if t and self.langs and _letter.search(t)]
        block: list[int] = []
        held: list[bytes] = []
        size = 0

        def settle():
            bits = self.code_lengths(held)
            best = bits.argmin(1)
            # the winner's posterior for 32 bytes at each language's mean cost
            gap = (bits - bits.min(1, keepdims=True)) * (32 / np.fromiter((len(h) for h in held), float))[:, None]
            scores[block] = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
            for i, b in zip(block, best, strict=True):
                langs[i] = self.langs[b]

        for i in usable:
            block.append(i)
            held.append(texts[i].encode())
            size += len(held[-1])
            if size > _BLOCK:
                settle()
                block, held, size = [], [], 0
        if block:
            settle()
        return langs, scores


def train(docs: DataFrame, held: Column, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> PpmModel:
    """Count the trees on rows with a label for which ``held`` is false.

    Rows are sampled by a hash of the id at a rate that gives ``sample_bytes`` of each language in
    expectation; smaller languages are taken whole. The counts, bounded by that, go to the driver.
    """
    known = docs.where(~held & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    sizes = known.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(F.octet_length(text_col)).alias("bytes")).orderBy("lang").collect()
    langs = [r.lang for r in sizes]
    if not langs:
        empty = np.empty(0, np.int64)
        return PpmModel([], empty, empty, empty, empty, order)
    rate = F.coalesce(*[F.when(F.col(lang_col) == r.lang, F.lit(min(1.0, sample_bytes / r.bytes))) for r in sizes])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) < rate * 1_000_000
    grams = known.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_gram_counts(order), "lang string, n int, gram long, count long")
    counted = grams.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toPandas().sort_values(["n", "gram", "lang"])
    lang = counted["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy(np.int64)
    return PpmModel(langs, lang, *(counted[c].to_numpy(np.int64) for c in ("n", "gram", "count")), order)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and a confidence from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predictions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("language ID")
        for texts in batches:
            langs, scores = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    predictions.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judge = F.pandas_udf(predictions, "lang string, score double").asNondeterministic()
    judged = docs.select(boxed(docs, lang_out, score_out), judge(F.col(text_col).cast("string")).alias("found"))
    return judged.select("row.*", F.col("found.lang").alias(lang_out), F.col("found.score").alias(score_out))
