"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the sum of the embeddings of itself and of its beginnings, found by 64-bit hashes; a hash
that no training document holds has no embedding.  Filters of several widths run over the words of
a text, the largest few answers of each (k-max pooling) reach a logistic layer.  All of it is
trained in numpy, by back propagation.  Filters of width one see each different word once, so that
a repeated line is no stronger than one.

The margin at which a text counts as toxic is calibrated by language on rows that the weights have
not seen, and lies at ``THRESHOLD`` of the score.  The language is told by the function words of the
text itself; no column but the text is an input of a score.

The model is fitted on the driver from at most ``sample`` labelled rows of each class, those with the
smallest hashes of their ids among texts of at most ``LONGEST`` characters; every document is scored,
over its whole text.

Defined cases: a NULL text is empty and is scored like any other, as one without words; labels that
are NULL take no part, of repeated labels of a document the smallest counts, other values than 0 are 1;
labels without documents are left out, a labelled id on several rows is learned from the text with the
smallest digest; without rows of both classes every score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.quality import held_out
from postloom.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 2000
LONGEST = 200_000
THRESHOLD = 0.7
# Embeddings: numbers of a word, lengths of its beginnings, training documents an entry must be in.
SIZE = 12
BEGINNINGS = range(3, 11)
LEAST_DOCUMENTS = 3
# Filters of each width, and how many of the largest answers of a filter are kept.
WIDTHS = (1, 2, 3)
FILTERS = 6
KEPT = 4
EPOCHS = 4
RATE = 0.03
DECAY = 1e-4
# Rows of both classes that a language needs for a margin of its own.
CALIBRATED = 8
# Characters read at a time, and different words a task remembers.
STRETCH = 1 << 20
REMEMBERED = 300_000

# Frequent function words by which a language is told.
LANGUAGES = {
    "en": "the of and to in is that for with are was this be as by it on at from".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "le les des et du une un est dans qui que pour par au sur pas il ne ce".split(),
    "es": "el los las y del en una un por con para es se al lo como su más".split(),
    "it": "il di che gli della per con sono non una del nel alla".split(),
    "pt": "o os as do da em um uma para com não dos das ao".split(),
}
WORDS = re.compile(r"\w+")
SLOTS = sum(WIDTHS)


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-case words of a whole text, some at a time."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and (text[end - 1].isalnum() or text[end - 1] == "_"):
            end += 1
        yield WORDS.findall(text[at:end].lower())
        at = end


def entries(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    found = [xxhash.xxh64_intdigest("=" + word)]
    found += [xxhash.xxh64_intdigest(word[:n]) for n in BEGINNINGS if n <= len(word)]
    return found


def tongue(word: str) -> int:
    """Bits of the languages whose function word this is."""
    return sum(1 << k for k, some in enumerate(LANGUAGES.values()) if word in some)


TONGUES = {w: tongue(w) for some in LANGUAGES.values() for w in some}


def language(counts: np.ndarray) -> int:
    """Number of the language with most function words (ties to the first), -1 without any."""
    bits = np.arange(len(counts))
    sums = [int(counts[(bits >> k) & 1 == 1].sum()) for k in range(len(LANGUAGES))]
    return int(np.argmax(sums)) if max(sums) else -1


@dataclass
class Net:
    """Embeddings by hash, filters (one block of columns per width and place), and the last layer."""

    rows: dict[int, int]
    embeddings: np.ndarray  # entries x SIZE
    filters: np.ndarray  # SIZE x (SLOTS * FILTERS)
    shifts: np.ndarray  # len(WIDTHS) * FILTERS
    last: np.ndarray  # len(WIDTHS) * FILTERS * KEPT
    bias: float
    slope: float = 1.0
    margins: dict[int, float] = field(default_factory=lambda: {-1: 0.0})

    def score(self, margin: float, tongue: int) -> float:
        at = self.margins.get(tongue, self.margins[-1])
        value = self.slope * (margin - at) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def constant(share: float) -> Net:
    """The model without anything to learn: one score for all texts."""
    flat = np.log(share / (1 - share)) - np.log(THRESHOLD / (1 - THRESHOLD))
    sizes = (1, SIZE), (SIZE, SLOTS * FILTERS), len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS * KEPT
    none = [np.zeros(s, np.float32) for s in sizes]
    return Net({}, *none, bias=float(flat))


def answers(at: np.ndarray, width: int, ids: np.ndarray) -> np.ndarray:
    """Filter answers (without shifts) at every place of a text whose words have projections ``at``.

    Word 0 is the empty place that fills texts shorter than the filter.
    """
    first = sum(w for w in WIDTHS if w < width) * FILTERS
    if len(ids) < width:
        ids = np.append(ids, np.zeros(width - len(ids), ids.dtype))
    places = len(ids) - width + 1
    total = at[ids[:places], first : first + FILTERS]
    for j in range(1, width):
        columns = slice(first + j * FILTERS, first + (j + 1) * FILTERS)
        total = total + at[ids[j : j + places], columns]
    return total


def largest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The KEPT largest values of each column in falling order, and their rows (-1: none)."""
    n = len(values)
    some = np.argpartition(values, n - KEPT, axis=0)[n - KEPT :] if n > KEPT else np.tile(
        np.arange(n)[:, None], values.shape[1]
    )
    found = np.take_along_axis(values, some, axis=0)
    order = np.argsort(-found, axis=0, kind="stable")
    some, found = np.take_along_axis(some, order, 0), np.take_along_axis(found, order, 0)
    if n < KEPT:
        fill = ((0, KEPT - n), (0, 0))
        some = np.pad(some, fill, constant_values=-1)
        found = np.pad(found, fill, constant_values=-np.inf)
    return found, some


def largest_values(values: np.ndarray) -> np.ndarray:
    """The KEPT largest values of each column, falling; the values of :func:`largest` alone."""
    n = len(values)
    if n > KEPT:
        values = np.partition(values, n - KEPT, axis=0)[n - KEPT :]
    found = -np.sort(-values, axis=0)
    if n < KEPT:
        found = np.pad(found, ((0, KEPT - n), (0, 0)), constant_values=-np.inf)
    return found


class Reader(dict):
    """Numbers of words and their filter projections, for a bounded number of words."""

    def __init__(self, net: Net):
        super().__init__()
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        # Projections and languages by number of the word; twice as long whenever full.
        self.at = np.zeros((1 << 12, SLOTS * FILTERS), np.float32)
        self.tongues = np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        self.fresh.append(word)
        return number

    def learn(self) -> None:
        row, flat, starts = self.net.rows.get, [], []
        for word in self.fresh:
            starts.append(len(flat))
            flat += [k for k in map(row, entries(word)) if k] or [0]
        if starts:
            while len(self) >= len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
                self.tongues = np.concatenate([self.tongues, np.zeros_like(self.tongues)])
            own = slice(len(self) + 1 - len(starts), len(self) + 1)
            vectors = np.add.reduceat(self.net.embeddings[flat], starts, axis=0)
            self.at[own] = vectors @ self.net.filters
            self.tongues[own] = [TONGUES.get(w, 0) for w in self.fresh]
        self.fresh = []

    def read(self, text: str | None) -> tuple[float, int]:
        """Margin and language of a whole text."""
        if len(self) > REMEMBERED:
            self.forget()
        net, number = self.net, self.__getitem__
        counts = np.zeros(1 << len(LANGUAGES), np.int64)
        best: list[np.ndarray | None] = [None] * len(WIDTHS)
        seen, earlier = np.zeros(0, np.int32), np.zeros(0, np.int32)
        for words in [*words_of(text)] or [[]]:
            ids = np.fromiter(map(number, words), np.int32, len(words))
            self.learn()
            counts += np.bincount(self.tongues[ids], minlength=len(counts))
            seen = np.unique(np.concatenate([seen, ids]))
            joined = np.concatenate([earlier, ids])
            for k, width in enumerate(WIDTHS[1:], 1):
                # The last words of a stretch are read again with the first of the next one.
                own = joined[len(earlier) - min(len(earlier), width - 1) :]
                if best[k] is None or len(own) >= width:
                    found = answers(self.at, width, own)
                    if best[k] is not None:
                        found = np.concatenate([best[k], found])
                    best[k] = largest_values(found)
            earlier = joined[-(max(WIDTHS) - 1) :]
        best[0] = largest_values(answers(self.at, 1, seen))
        pooled = np.stack([*best])
        pooled = np.maximum(pooled + net.shifts.reshape(len(WIDTHS), 1, FILTERS), 0)
        return net.bias + float(pooled.ravel() @ net.last), language(counts)


def class_ratios(documents: list[np.ndarray], labels: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
    """Entries of enough documents, and the shrunk log ratio of label 1 of each; row 0 is no entry.

    ``documents``: the different entries of each document.
    """
    found = [
        np.unique(np.concatenate([d for d, y in zip(documents, labels) if y == label]), return_counts=True)
        for label in (0, 1)
    ]
    known = np.union1d(found[0][0], found[1][0])
    counts = np.zeros((2, len(known)), np.int64)
    for label, (own, times) in enumerate(found):
        counts[label, np.searchsorted(known, own)] = times
    enough = counts.sum(axis=0) >= LEAST_DOCUMENTS
    known, counts = known[enough], counts[:, enough]
    total, hits = np.append(0, counts.sum(axis=0)), np.append(0, counts[1])
    share, prior = labels.mean(), 2.0
    chance = (hits + prior * share) / (total + prior)
    ratios = np.log(chance / (1 - chance)) - np.log(share / (1 - share))
    return {h: k + 1 for k, h in enumerate(known.tolist())}, ratios


def start(rows: dict[int, int], ratios: np.ndarray, seed: int = 0) -> Net:
    """The first embedding number is the ratio, which the first filters read; the rest is random."""
    r = np.random.default_rng(seed)
    embeddings = r.normal(0, 0.05, (len(ratios), SIZE))
    embeddings[:, 0] = ratios * 0.2
    embeddings[0] = 0
    filters = r.normal(0, 0.1, (SIZE, SLOTS * FILTERS))
    shifts, last = np.zeros(len(WIDTHS) * FILTERS), np.zeros((len(WIDTHS), KEPT, FILTERS))
    first = 0
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            filters[:, first + j * FILTERS] = 0
            filters[0, first + j * FILTERS] = 1.0 / width
        last[k, :, 0] = 0.2
        first += width * FILTERS
    # The last layer is used in the order of Reader.read: width, rank, filter.
    return Net(rows, embeddings, filters, shifts, last.ravel(), bias=-1.0)


def different_entries(text: str) -> np.ndarray:
    words = {w for some in words_of(text) for w in some}
    return np.unique(np.array([h for w in words for h in entries(w)], np.uint64))


@dataclass
class Example:
    """A text as different words: entries of each, and the words in the order of the text."""

    flat: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    tongue: int


def example(text: str, rows: dict[int, int]) -> Example:
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers) + 1) for some in words_of(text) for w in some]
    flat, starts = [0], [0]
    for word in numbers:
        starts.append(len(flat))
        flat += [k for k in map(rows.get, entries(word)) if k] or [0]
    counts = np.zeros(1 << len(LANGUAGES), np.int64)
    words = list(numbers)
    for i in ids:
        counts[TONGUES.get(words[i - 1], 0)] += 1
    return Example(np.array(flat, np.int32), np.array(starts, np.int32), np.array(ids, np.int32), language(counts))


def forward(net: Net, one: Example):
    """Margin of an example and what its gradient needs."""
    vectors = np.add.reduceat(net.embeddings[one.flat], one.starts, axis=0)
    at = vectors @ net.filters
    pooled, places = [], []
    for k, width in enumerate(WIDTHS):
        ids = np.unique(one.ids) if width == 1 else one.ids
        if len(ids) < width:
            ids = np.append(ids, np.zeros(width - len(ids), np.int64))
        found, some = largest(answers(at, width, ids))
        pooled.append(found + net.shifts[k * FILTERS : (k + 1) * FILTERS])
        places.append((ids, some))
    values = np.maximum(np.stack(pooled), 0)
    return net.bias + float(values.ravel() @ net.last), vectors, values, places


def gradients(net: Net, one: Example, slope: float, state) -> list[tuple[np.ndarray, tuple]]:
    """What a change of the margin means for every weight: (gradient, where) per array of the net."""
    _, vectors, values, places = state
    back = (net.last.reshape(values.shape) * slope) * (values > 0)
    to_filters, to_vectors = np.zeros_like(net.filters), np.zeros_like(vectors)
    first = 0
    for k, width in enumerate(WIDTHS):
        ids, some = places[k]
        for rank, f in zip(*np.nonzero(back[k])):
            for j in range(width):
                column, word = first + j * FILTERS + f, ids[some[rank, f] + j]
                to_filters[:, column] += back[k, rank, f] * vectors[word]
                to_vectors[word] += back[k, rank, f] * net.filters[:, column]
        first += width * FILTERS
    to_vectors[0] = 0
    moved = np.flatnonzero(to_vectors.any(axis=1))
    ends = np.append(one.starts[1:], len(one.flat))
    hit = [one.flat[one.starts[w] : ends[w]] for w in moved]
    index = np.concatenate(hit) if hit else np.zeros(0, np.int64)
    spread = np.repeat(to_vectors[moved], [len(h) for h in hit], axis=0)
    rows, where = np.unique(index, return_inverse=True)
    to_rows = np.zeros((len(rows), SIZE))
    np.add.at(to_rows, where, spread)
    if len(rows) and rows[0] == 0:  # no entry, never moved
        rows, to_rows = rows[1:], to_rows[1:]
    return [(to_rows, rows), (to_filters, ...), (back.sum(axis=1).ravel(), ...), (slope * values.ravel(), ...)]


def train_net(net: Net, examples: list[Example], labels: np.ndarray, seed: int = 0) -> None:
    """Adaptive gradient steps on the logistic loss, classes weighing alike."""
    share = np.bincount(labels, minlength=2) / len(labels)
    weights = 0.5 / share[labels]
    arrays = [net.embeddings, net.filters, net.shifts, net.last]
    sums = [np.full(a.shape, 0.01) for a in arrays]
    bias_sum, order = 0.01, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            state = forward(net, examples[i])
            chance = 1 / (1 + np.exp(-np.clip(state[0], -40, 40)))
            slope = weights[i] * (chance - labels[i])
            if abs(slope) < 1e-3:
                continue
            for array, total, (move, where) in zip(
                arrays, sums, gradients(net, examples[i], slope, state)
            ):
                move = move + DECAY * array[where]
                total[where] += move**2
                array[where] -= RATE * move / np.sqrt(total[where])
            bias_sum += slope**2
            net.bias -= RATE * slope / np.sqrt(bias_sum)


def best_margin(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The margin between two neighbours above which the balance of hits and misses (F1) is best."""
    order = np.argsort(-margins, kind="stable")
    sorted_margins, hits = margins[order], np.cumsum(weights[order] * labels[order])
    f1 = 2 * hits / (np.cumsum(weights[order]) + (weights * labels).sum())
    # Only between unequal margins.
    ends = np.append(sorted_margins[1:] < sorted_margins[:-1], True)
    f1 = np.where(ends, f1, -1)
    k = int(np.argmax(f1))
    return float((sorted_margins[k] + sorted_margins[min(k + 1, len(order) - 1)]) / 2)


def calibrate(net: Net, margins: np.ndarray, tongues: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Slope and margins by language; a language with few rows has the margin of all."""
    from postloom.llm.quality import logistic

    net.slope = max(logistic(margins, labels)[0], 1e-3)
    net.margins = {-1: best_margin(margins, labels, weights)}
    for k in range(len(LANGUAGES)):
        own = tongues == k
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= CALIBRATED:
            net.margins[k] = best_margin(margins[own], labels[own], weights[own])


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None) -> Net:
    """Every fourth row is kept for the calibration, the others fit the weights.

    ``weights``: how many rows of the table one of these stands for.
    """
    weights = np.ones(len(labels)) if weights is None else weights
    held = np.arange(len(texts)) % 4 == 3
    if not len(texts) or len({*labels[held]}) < 2 or len({*labels[~held]}) < 2:
        share = float(np.average(labels, weights=weights)) if len(texts) else 0.5
        return constant(min(max(share, 0.001), 0.999))
    rows, ratios = class_ratios(
        [different_entries(t) for t, out in zip(texts, held) if not out], labels[~held]
    )
    net = start(rows, ratios)
    examples = [example(t, rows) for t in texts]
    train_net(net, [e for e, out in zip(examples, held) if not out], labels[~held])
    rest = [e for e, out in zip(examples, held) if out]
    margins = np.array([forward(net, e)[0] for e in rest])
    tongues = np.array([e.tongue for e in rest])
    calibrate(net, margins, tongues, labels[held], weights[held])
    return net


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``sample`` labelled rows of each class that are not held out, and the sizes of the classes."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min((F.col("toxic") != 0).cast("int")).alias("label"))
    )
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).select("doc_id").distinct()
    known = materialize(known.join(short, "doc_id", "left_semi"), "labels")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for label in (0, 1)
    ]
    return materialize(parts[0].unionByName(parts[1]), "labelled"), sizes


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """The model of a bounded sample of the labelled rows that are not held out."""
    docs = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    chosen, sizes = labelled(docs, labels, sample)
    # One text per labelled id, whatever the number of its rows.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by(F.coalesce("text", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")
    )
    found = rows.toPandas()
    found = found.iloc[np.argsort([xxhash.xxh64_intdigest(str(i)) for i in found["doc_id"]])]
    values = found["label"].to_numpy(np.int64)
    drawn = np.bincount(values, minlength=2)
    weights = np.array([sizes.get(v, 1) / drawn[v] for v in values])
    return fit(found["text"].tolist(), values, weights)


def scorer(docs: DataFrame, net: Net):
    """A column function from text to score; only the text crosses to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (net.rows, net.embeddings.astype(np.float32), net.filters, net.shifts, net.last, net.bias, net.slope, net.margins)
    )

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Net(*shared.value)
        reader = Reader(model)
        for texts in parts:
            yield pd.Series([model.score(*reader.read(t)) for t in texts], dtype=float)

    return score


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    score = scorer(docs, train(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
