"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text becomes a sparse unit vector: words and runs of signs in order, each with its shape where
that says something (capitals throughout, a sign run glued to a word, a word repeated at once),
then 1-grams and 2-grams of them hashed into ``2**bits`` slots. FTRL-proximal with per-coordinate
rates fits the weights on a bounded sample of labelled rows; scoring is a sparse dot product.

Defined results: null and empty texts have no feature and score the intercept's probability;
repeated rows are scored one by one; an empty table gives an empty result; without labelled rows
the score is 0.5; the result columns replace columns of the same name,
and all others are kept, of any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, label_sample, labelled_texts

#: Bound of the labelled sample; hash slots as a power of two; passes over the sample.
TRAIN_ROWS, BITS, EPOCHS = 8_000, 18, 3
_token = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME, _UPPER = np.uint64(0x1234567), np.uint64(0x7654321)


class _Hashes(dict):
    """Token -> 64-bit hash; words in capitals throughout, numbers and sign runs share one by shape."""

    def __missing__(self, token: str) -> int:
        import xxhash

        shape = token
        if token[0].isalpha() and len(token) > 1 and token.isupper():
            shape = "\x00upper"
        elif token.isdigit():
            shape = "\x00number"
        found = xxhash.xxh64_intdigest(shape.lower())
        if len(self) < 500_000:
            self[token] = found
        return found


_hashes = _Hashes()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text: counts damped by a logarithm, then scaled to length 1."""
    tokens = _token.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * _MIX + h[1:]
    pairs[h[:-1] == h[1:]] = _SAME
    grams = (np.concatenate([h, pairs]) * _MIX) >> np.uint64(64 - bits)
    counts = np.bincount(grams.astype(np.int64), minlength=1) if len(grams) > (1 << bits) // 4 else None
    if counts is None:
        slots, counts = np.unique(grams, return_counts=True)
        slots = slots.astype(np.int64)
    else:
        slots = np.flatnonzero(counts)
        counts = counts[slots]
    values = np.log1p(counts).astype(np.float32)
    return slots, values / np.sqrt((values * values).sum())


class Ftrl:
    """FTRL-proximal for logistic loss: adaptive rates a coordinate, L1 for sparsity, L2."""

    def __init__(self, bits: int = BITS, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        at, x = np.append(slots, 1 << self.bits), np.append(values, 0.3)  # the last slot is the intercept
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient * gradient


class QualityModel:
    def __init__(self, weights: np.ndarray, bits: int = BITS) -> None:
        self.weights, self.bits = weights.astype(np.float32), bits

    def score(self, text: str | None) -> float:
        slots, values = features(text, self.bits)
        margin = float(self.weights[slots] @ values) + 0.3 * float(self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _vectors(bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, values = features(text, bits)
                packed = [pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([values.astype("<f4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *packed], ["label", "slots", "vals"])

    return run


def train(docs: DataFrame, labels: DataFrame, held: Column, rows: int = TRAIN_ROWS, bits: int = BITS, epochs: int = EPOCHS, label: str = "quality") -> QualityModel:
    """Fit on at most ``rows`` labelled documents for which ``held`` (over the labels' columns) is false.

    Only that bounded sample's sparse vectors reach the driver, where the updates run in sequence.
    """
    sample = labelled_texts(docs, label_sample(labels, label, held, rows)).mapInArrow(_vectors(bits), "label int, slots binary, vals binary")
    vectors = [(np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r.vals, "<f4"), float(r.label > 0)) for r in sample.toLocalIterator()]
    vectors.sort(key=lambda v: (v[0].tobytes(), v[2]))  # an order that does not hang on partitions
    model = Ftrl(bits)
    order = np.random.default_rng(17)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            model.learn(*vectors[i])
    return QualityModel(model.weights(slice(None)), bits)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is labelled 1, in column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score_of = F.pandas_udf(scores, "double").asNondeterministic()
    return docs.select(boxed(docs, out), score_of(F.col(text_col).cast("string")).alias("found")).select("row.*", F.col("found").alias(out))
