"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, drops accents and zero-width characters, maps look-alike letters of other
scripts to Latin ones and digits that stand for letters to those letters, so disguised spellings
meet the lexicon's own. The lexicon and its weights (log-odds of document frequencies), the
exception phrases and the calibration are learned from a bounded sample of labelled rows; callers
may add terms and exceptions of their own.

Defined results: null and empty texts score as texts without a match; repeated rows are scored
one by one; an empty table gives an empty result; without labelled rows of both classes every
score is 0; the result columns replace columns of the same name,
and all others are kept, of any name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, kept, label_sample, labelled_texts

#: Bounds of the labelled sample, and of the lexicon and the exception phrases learned from it; letters of a term, at least.
TRAIN_ROWS, LEXICON_TERMS, EXCEPTIONS, LEAST_LETTERS = 30_000, 2_000, 1_000, 3
#: A term needs this likelihood ratio (G squared) and this log-odds.
LEAST_RATIO, LEAST_ODDS = 24.0, 1.8

# Letters of other scripts that look like Latin letters, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
    "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | {ord(c): "" for c in INVISIBLE}
    spans = [(0xC0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x2190), (0x2460, 0x2500), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)]
    for code in (c for a, b in spans for c in range(a, b)):
        if code not in table:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            plain = "".join(LOOKALIKES.get(c, DIGITS.get(c, c)) for c in plain)
            if plain != chr(code):
                table[code] = plain
    return table


FOLDS = _fold_table()
_signed = re.compile("[" + re.escape("".join(SIGNS)) + r"](?=[^\W\d_])")
_word = re.compile(r"[^\W\d_]+")
_next_word = re.compile(r" [^\W\d_]+")


def fold(text: str) -> str:
    folded = text.lower().translate(FOLDS)
    if any(s in folded for s in SIGNS):
        folded = _signed.sub(lambda m: SIGNS[m[0]], folded)
    return folded


class Matcher:
    """Whole-word matches of weighted terms in folded text, those inside an exception phrase aside."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = ()) -> None:
        self.weights = {fold(t): float(w) for t, w in weights.items() if t}
        self.exceptions = {fold(p) for p in exceptions if p}
        self.automaton = ahocorasick.Automaton()
        for pattern in self.weights.keys() | self.exceptions:
            self.automaton.add_word(pattern, pattern)
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, folded: str) -> list[tuple[int, int, str]]:
        """(begin, end, term) of counted matches."""
        if not len(self.automaton):
            return []
        found, barred, n = [], [], len(folded)
        for last, pattern in self.automaton.iter(folded):
            begin, end = last + 1 - len(pattern), last + 1
            if (begin and folded[begin - 1].isalpha()) or (end < n and folded[end].isalpha()):
                continue
            if pattern in self.exceptions:
                barred.append((begin, end))
            if pattern in self.weights:
                found.append((begin, end, pattern))
        if not barred:
            return found
        kept, i, reach = [], 0, -1
        barred.sort()
        for begin, end, pattern in sorted(found):
            while i < len(barred) and barred[i][0] <= begin:
                reach, i = max(reach, barred[i][1]), i + 1
            if end > reach:
                kept.append((begin, end, pattern))
        return kept

    def density(self, text: str | None) -> float:
        """Summed weights of the matches over a power of the length in words."""
        if not text:
            return 0.0
        folded = fold(text)
        weight = sum(self.weights[p] for _, _, p in self.spans(folded))
        return weight / math.sqrt(folded.count(" ") + folded.count("\n") + 20) if weight else 0.0


def _word_counts(batches):
    import pyarrow as pa

    kept("toxicity")
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[label > 0] += 1
            counts[label > 0].update({w for w in _word.findall(fold(text)) if len(w) >= LEAST_LETTERS})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield _counted(pa, counts)
                counts = (Counter(), Counter())
    yield _counted(pa, counts)
    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())], ["term", "clean", "toxic"])


def _counted(pa, counts):
    terms = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def _log_odds(toxic, clean, toxic_docs, clean_docs) -> Column:
    return F.log(((toxic + 0.5) / (toxic_docs + 1)) / ((clean + 0.5) / (clean_docs + 1)))


def learn_lexicon(sample: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms that documents labelled 1 hold far more often, with their log-odds."""
    counts = sample.mapInArrow(_word_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("term = ''").first()
    if not total or not total.clean or not total.toxic:
        return {}
    clean, toxic, share = F.col("clean"), F.col("toxic"), total.toxic / (total.toxic + total.clean)
    both = toxic + clean
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))
    odds = _log_odds(toxic, clean, total.toxic, total.clean)
    best = counts.where("term != '' and toxic >= 3").select("term", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
    return {r.term: r.odds for r in best.orderBy(F.desc("ratio"), "term").limit(terms).collect()}


def _phrases(matcher):
    """Documents' (phrase, label) where a phrase is a match with the word before or after it."""

    def run(batches):
        import pyarrow as pa

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, phrases = fold(text), set()
                for begin, end, _ in matcher.spans(folded):
                    if begin > 1 and folded[begin - 1] == " " and folded[begin - 2].isalpha():
                        at = begin - 2
                        while at and folded[at - 1].isalpha():
                            at -= 1
                        phrases.add(folded[at:end])
                    if after := _next_word.match(folded, end):
                        phrases.add(folded[begin:end] + after[0])
                counts[label > 0].update(phrases)
        yield _counted(pa, counts)

    return run


def learn_exceptions(sample: DataFrame, weights: dict[str, float], least: int = 5, most: int = EXCEPTIONS) -> list[str]:
    """Phrases round a term that clean documents hold at least ``least`` times and toxic ones hardly ever."""
    if not weights:
        return []
    counts = sample.mapInArrow(_phrases(Matcher(weights)), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counts.where((F.col("clean") >= least) & (F.col("clean") >= 4 * F.col("toxic")))
    return [r.term for r in found.orderBy(F.desc("clean"), "term").limit(most).collect()]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a one-feature logistic regression (Newton steps, small ridge)."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class ToxicityModel:
    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), calibration: tuple[float, float] | None = None) -> None:
        self.weights, self.exceptions, self.calibration = dict(weights), list(exceptions), calibration
        self._matcher = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.calibration

    def __setstate__(self, state):
        (self.weights, self.exceptions, self.calibration), self._matcher = state, None

    @property
    def matcher(self) -> Matcher:
        self._matcher = self._matcher or Matcher(self.weights, self.exceptions)
        return self._matcher

    def score(self, text: str | None) -> float:
        if self.calibration is None:
            return 0.0
        a, b = self.calibration
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * self.matcher.density(text)))))


def train(docs: DataFrame, labels: DataFrame, held: Column, rows: int = TRAIN_ROWS, exceptions: list[str] = ()) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents for which ``held`` (over the labels' columns) is false."""
    sample = labelled_texts(docs, label_sample(labels, "toxic", held, rows))
    weights = learn_lexicon(sample)
    if not weights:
        return ToxicityModel({}, exceptions)
    phrases = [*exceptions, *learn_exceptions(sample, weights)]
    model = ToxicityModel(weights, phrases)

    def densities(texts: pd.Series) -> pd.Series:
        return pd.Series([model.matcher.density(t) for t in texts], dtype="float64")

    densities.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    density = F.pandas_udf(densities, "double")
    seen = sample.select("label", density("text").alias("x")).toPandas()
    model.calibration = _logistic(seen["x"].to_numpy(float), (seen["label"].to_numpy() > 0).astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1, in column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("toxicity")
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score_of = F.pandas_udf(scores, "double").asNondeterministic()
    return docs.select(boxed(docs, out), score_of(F.col(text_col).cast("string")).alias("found")).select("row.*", F.col("found").alias(out))
