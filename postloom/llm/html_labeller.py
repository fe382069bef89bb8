"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of text blocks.  Each block is read as a vector of its tag path and a vector of
its hashed words; a bidirectional LSTM carries what stands before and after through the whole page, and
a logistic output says of every block whether it belongs to the article.  The model is trained
here, on invented layouts (``html_layouts``), with a fixed seed.

Defined cases: a NULL or empty page, and one without a main block, give an empty text; text without
any tag is one block; markup may be broken or cut off anywhere; pages of any length are read whole;
repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from postloom.llm.html_blocks import DIMS, Numbers, blocks_of
from postloom.llm.html_layouts import Pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIDDEN = 24
TRAINING_PAGES, BATCH, PASSES, RATE = 2000, 32, 4, 0.012
# Blocks that are labelled at once; a bound of memory only.
BLOCKS = 20_000

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _start(seed: int) -> Weights:
    r = np.random.default_rng(seed)
    weights = {"out": r.normal(0, 0.1, 2 * HIDDEN), "out_bias": np.zeros(1)}
    for way in "fb":
        weights[way + "x"] = r.normal(0, DIMS**-0.5, (DIMS, 4 * HIDDEN))
        weights[way + "h"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        weights[way + "b"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return {name: value.astype(np.float32) for name, value in weights.items()}


def _run(x: np.ndarray, mask: np.ndarray, w: Weights, way: str, keep: bool):
    """States of one direction, time first: x (steps, pages, DIMS), mask (steps, pages)."""
    steps, pages, _ = x.shape
    inputs = x @ w[way + "x"] + w[way + "b"]
    h = c = np.zeros((pages, HIDDEN), x.dtype)
    states, tape = np.zeros((steps, pages, HIDDEN), x.dtype), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        gates = inputs[t] + h @ w[way + "h"]
        ifo = sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(gates[:, 3 * HIDDEN :])
        on = mask[t][:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        if keep:
            tape.append((t, h, c, i, f, o, g, squashed, on))
        h, c = np.where(on, o * squashed, h), np.where(on, new, c)
        states[t] = h
    return states, tape


def _back(x, w: Weights, way: str, tape: list, wanted: np.ndarray, grads: Weights) -> None:
    dh = dc = np.zeros(wanted.shape[1:], x.dtype)
    dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), x.dtype)
    for t, h, c, i, f, o, g, squashed, on in reversed(tape):
        dh = dh + wanted[t]
        inner = np.where(on, dh, 0)
        dnew = np.where(on, dc, 0) + inner * o * (1 - squashed**2)
        d = np.concatenate(
            [dnew * g * i * (1 - i), dnew * c * f * (1 - f), inner * squashed * o * (1 - o), dnew * i * (1 - g**2)], 1
        )
        dgates[t] = d
        grads[way + "h"] += h.T @ d
        dh = np.where(on, d @ w[way + "h"].T, dh)
        dc = np.where(on, dnew * f, dc)
    flat = dgates.reshape(-1, 4 * HIDDEN)
    grads[way + "x"] += x.reshape(-1, DIMS).T @ flat
    grads[way + "b"] += flat.sum(axis=0)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((lengths.max(), len(rows), DIMS), rows[0].dtype)
    for k, row in enumerate(rows):
        x[: len(row), k] = row
    return x, np.arange(len(x))[:, None] < lengths


def chances(rows: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """For each page, the chance of each of its blocks to be main text."""
    x, mask = _padded(rows)
    both = np.concatenate([_run(x, mask, w, way, False)[0] for way in "fb"], axis=2)
    p = sigmoid(both @ w["out"] + w["out_bias"][0])
    return [p[: len(r), k] for k, r in enumerate(rows)]


def _gradients(rows: list[np.ndarray], labels: list[np.ndarray], w: Weights) -> Weights:
    x, mask = _padded(rows)
    runs = {way: _run(x, mask, w, way, True) for way in "fb"}
    both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
    goal = np.zeros(mask.shape, x.dtype)
    for k, label in enumerate(labels):
        goal[: len(label), k] = label
    error = np.where(mask, sigmoid(both @ w["out"] + w["out_bias"][0]) - goal, 0) / np.float32(mask.sum())
    grads = {name: np.zeros_like(value) for name, value in w.items()}
    grads["out"] = np.einsum("tp,tph->h", error, both)
    grads["out_bias"] = error.sum(keepdims=True).reshape(1)
    wanted = error[:, :, None] * w["out"]
    for k, way in enumerate("fb"):
        _back(x, w, way, runs[way][1], wanted[:, :, k * HIDDEN : (k + 1) * HIDDEN], grads)
    return grads


def examples(seed: int, pages: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of the blocks of invented pages."""
    source, numbers, rows, labels = Pages(seed), Numbers(), [], []
    for _ in range(pages):
        page, texts = source.page()
        blocks = blocks_of(page)
        at, label = 0, []
        for block in blocks:
            main = at < len(texts) and block.text == texts[at]
            at += main
            label.append(main)
        rows.append(numbers.of(blocks))
        labels.append(np.array(label, np.float32))
    return rows, labels


@functools.lru_cache(maxsize=1)
def trained(seed: int = 0) -> Weights:
    """Weights after Adam steps over invented pages; the same seed gives the same weights."""
    rows, labels = examples(seed, TRAINING_PAGES)
    w, order = _start(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, PASSES * (len(rows) // BATCH)
    for _ in range(PASSES):
        # Pages of like length share a batch.
        shuffled = sorted(order.permutation(len(rows)).tolist(), key=lambda i: len(rows[i]) // 4)
        starts = order.permutation(np.arange(0, len(rows) - BATCH + 1, BATCH))
        for start in starts.tolist():
            chosen = shuffled[start : start + BATCH]
            grads = _gradients([rows[i] for i in chosen], [labels[i] for i in chosen], w)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                size = np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8
                w[k] = w[k] - np.float32(rate / (1 - 0.9**step)) * mean[k] / size
    return w


def main_texts(pages: list[str | None], w: Weights, numbers: Numbers) -> list[str]:
    """The main text of each page: its main blocks, joined by an empty line."""
    blocks = [blocks_of(page) for page in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while order:
        group = [order.pop()]  # the longest first; steps of a group are as many as its longest has
        longest = len(blocks[group[0]])
        while order and (len(group) + 1) * longest <= BLOCKS and 2 * len(blocks[order[-1]]) + 8 >= longest:
            group.append(order.pop())
        for i, p in zip(group, chances([numbers.of(blocks[i]) for i in group], w)):
            texts[i] = "\n\n".join(b.text for b, c in zip(blocks[i], p) if c >= 0.5)
    return texts


def extract(pages: DataFrame, seed: int = 0) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(seed))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(part.column("html").to_pylist(), shared.value, numbers)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(read, schema)
