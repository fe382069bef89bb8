"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

A document is the set of its hashed n-grams (words, word pairs, byte sequences).  Each
indicator is scaled by the log ratio of its smoothed class counts, and a linear hinge-loss model over
the scaled indicators is fitted by dual coordinate descent; a logistic curve fitted on margins of
rows left out of that turns margins into scores.

The model is fitted on the driver from at most ``sample`` labelled rows, those with the smallest
hashes of their ids; every document is scored, over its whole text.

Defined cases: a NULL text is empty and is scored like any other, by the intercept; labels that are NULL
take no part, of repeated labels of a document the smallest counts, other values than 0 are 1; labels
without documents are left out; without rows of both classes every score is the share of
label 1, or 0.5 without any.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.shared import free_name, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
SIZE = 1 << BITS
SAMPLE = 4000
# Byte sequences of these lengths are n-grams.
BYTES = (2, 3, 4)
# Shares of doubled words told apart: 1, 1/2, 1/4, ... of all words.
SHARES = 8
SMOOTHING = 1.0
# Power of the number of n-grams by which their sum is divided.
LENGTH = 0.5
COST = 1.0
EPOCHS = 6


class WordCodes(dict):
    """32-bit code of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def _mark(seen: np.ndarray, codes: np.ndarray, salt: int) -> None:
    codes = (codes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    seen[codes >> np.uint64(64 - BITS)] = True


def ngrams(text: str | None, seen: np.ndarray, words: WordCodes) -> np.ndarray:
    """Indices of the n-grams of a whole text; ``seen`` is all False before and after."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    step = 1 << 20  # long texts in overlapping stretches, to bound memory
    for start in range(0, len(raw), step):
        part = raw[start : start + step + max(BYTES) - 1].astype(np.uint64)
        code = part
        for n in range(2, max(BYTES) + 1):
            code = (code[:-1] << np.uint64(8)) | part[n - 1 :]
            if n in BYTES:
                _mark(seen, code, n << 40)
            if not len(code):
                break
    tokens = data.split()
    if tokens:
        codes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
        _mark(seen, codes, 1 << 41)
        _mark(seen, (codes[:-1] * np.uint64(31)) ^ (codes[1:] << np.uint64(7)), 1 << 42)
        # Pairs of one word twice, whatever the word: how large their share is, in halvings.
        twice = int((codes[:-1] == codes[1:]).sum())
        halvings = [k for k in range(SHARES) if twice << k >= len(tokens)]
        _mark(seen, np.array(halvings, np.uint64), 1 << 43)
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def collect_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, words = np.zeros(SIZE, bool), WordCodes()
    for batch in batches:
        rows = [ngrams(t.as_py(), seen, words).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
            names=["doc_id", "label", "grams"],
        )


@dataclass(frozen=True)
class Model:
    """score = logistic(slope * (bias + sum(weights of n-grams) / their number ** LENGTH) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        return self.bias + float(self.weights[grams].sum()) / max(len(grams), 1) ** LENGTH

    def score(self, grams: np.ndarray) -> float:
        value = self.slope * self.margin(grams) + self.shift
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.full(SIZE, SMOOTHING), np.full(SIZE, SMOOTHING)]
    for grams, label in zip(rows, labels):
        counts[label][grams] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 0):
    """Hinge-loss weights over scaled indicators and an intercept; classes weigh alike."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    ceiling = COST * 0.5 / share[labels]
    values = [ratios[g] / max(len(g), 1) ** LENGTH for g in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    weights, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            grams, x = rows[i], values[i]
            gradient = signs[i] * (float(weights[grams] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), ceiling[i])
            change = (new - alpha[i]) * signs[i]
            if change:
                weights[grams] += change * x
                bias += change
                alpha[i] = new
    return weights * ratios, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to the probability of label 1, by Newton steps."""
    # Smoothed targets keep the curve finite when the margins separate the classes.
    ones = labels.sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - goal))
        at = at - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Every fifth row is kept for the curve, the others fit the weights."""
    held = np.arange(len(rows)) % 5 == 4
    both = len(rows) and 0 < labels[~held].sum() < (~held).sum() and 0 < labels[held].sum() < held.sum()
    if not both:
        share = float(np.clip(labels.mean(), 0.001, 0.999)) if len(rows) else 0.5
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    some = [g for g, h in zip(rows, held) if not h]
    ratios = log_ratios(some, labels[~held])
    weights, bias = dual_descent(some, labels[~held], ratios)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(g) for g, h in zip(rows, held) if h])
    slope, shift = logistic(margins, labels[held])
    return Model(model.weights, bias, slope, shift)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled rows that are not held out."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") != 0).cast("int")).alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(collect_ngrams, "doc_id long, label int, grams binary").toPandas()
    found = found.sort_values(["doc_id", "grams"])
    return fit(
        [np.frombuffer(g, np.int32) for g in found["grams"]], found["label"].to_numpy(np.int64)
    )


def scorer(docs: DataFrame, model: Model):
    """A column function from text to score; only the text crosses to Python."""
    parts = (model.weights, model.bias, model.slope, model.shift)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, words, model = np.zeros(SIZE, bool), WordCodes(), Model(*shared.value)
        for texts in parts:
            yield pd.Series([model.score(ngrams(t, seen, words)) for t in texts], dtype=float)

    return score


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    score = scorer(docs, train(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that are predicted to be of low quality."""
    score, name = scorer(docs, train(docs, labels, sample)), free_name(docs, "score")
    return docs.withColumn(name, score("text")).where(F.col(name) >= 0.5).drop(name)
