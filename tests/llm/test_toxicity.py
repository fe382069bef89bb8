"""Toxicity classifier: plain convolution, numeric gradients, held-out accuracy, awkward cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from postloom.llm import toxicity
from postloom.llm.shared import table
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def small_net(texts: list[str], seed: int = 3) -> toxicity.Net:
    """A net with random weights that knows the entries of some words of the texts."""
    r = np.random.default_rng(seed)
    words = sorted({w for t in texts for w in re.findall(r"\w+", t.lower())})[::2]
    known = sorted({h for w in words for h in toxicity.entries(w)})
    net = toxicity.start({h: k + 1 for k, h in enumerate(known)}, r.normal(0, 2, len(known) + 1))
    net.last = r.normal(0, 1, net.last.shape)
    net.shifts = r.normal(0, 0.1, net.shifts.shape)
    return net


def plain_margin(net: toxicity.Net, text: str) -> float:
    """The same sum by loops over places, filters and ranks."""
    words = re.findall(r"\w+", text.lower())
    vectors = {w: sum((net.embeddings[net.rows[h]] for h in toxicity.entries(w) if h in net.rows), np.zeros(toxicity.SIZE)) for w in words}
    total, first = net.bias, 0
    last = net.last.reshape(len(toxicity.WIDTHS), toxicity.KEPT, toxicity.FILTERS)
    for k, width in enumerate(toxicity.WIDTHS):
        row = [vectors[w] for w in (sorted(set(words)) if width == 1 else words)]
        row += [np.zeros(toxicity.SIZE)] * (width - len(row))
        for f in range(toxicity.FILTERS):
            found = [
                sum(float(row[p + j] @ net.filters[:, first + j * toxicity.FILTERS + f]) for j in range(width))
                for p in range(len(row) - width + 1)
            ]
            for rank, value in enumerate(sorted(found, reverse=True)[: toxicity.KEPT]):
                total += last[k, rank, f] * max(value + net.shifts[k * toxicity.FILTERS + f], 0)
        first += width * toxicity.FILTERS
    return total


TEXTS = ["", "One", "two Words", "Ünïcödé, text. and_more 12", cases.prose(1, 40), cases.prose(2, 300), "a a a b " * 30]


@pytest.mark.parametrize("stretch", [1 << 20, 37])
def test_reader_is_the_plain_convolution(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    net = small_net(TEXTS)
    reader = toxicity.Reader(net)
    for text in TEXTS * 2:
        margin, _ = reader.read(text)
        assert margin == pytest.approx(plain_margin(net, text), abs=1e-4)
        assert toxicity.forward(net, toxicity.example(text, net.rows))[0] == pytest.approx(plain_margin(net, text))


def test_what_is_remembered_changes_nothing(monkeypatch):
    net = small_net(TEXTS)
    want = [toxicity.Reader(net).read(t) for t in TEXTS]
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    reader = toxicity.Reader(net)
    assert [reader.read(t) for t in TEXTS] == want


def test_gradients_are_those_of_the_margin():
    text = cases.prose(5, 30)
    net = small_net([text])
    one = toxicity.example(text, net.rows)
    moves = toxicity.gradients(net, one, 1.0, toxicity.forward(net, one))
    arrays = [net.embeddings, net.filters, net.shifts, net.last]
    r = random.Random(0)
    for array, (move, where) in zip(arrays, moves):
        full = np.zeros(array.shape)
        full[where] += move
        flat, step = array.reshape(-1), 1e-6
        for i in r.sample(range(flat.size), min(60, flat.size)):
            held = flat[i]
            flat[i] = held + step
            up = toxicity.forward(net, one)[0]
            flat[i] = held - step
            down = toxicity.forward(net, one)[0]
            flat[i] = held
            if array is net.embeddings and i < toxicity.SIZE:
                continue  # row 0 is no entry and stays as it is
            assert full.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def invented(n: int, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """Texts of two languages; a toxic one holds two or more inflected forms of a stem of its language."""
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        frame, stem = r.choice([("the of and to in", "zorv"), ("der die und das mit", "plunk")])
        words = [r.choice(frame.split() + ["".join(r.choices("abeinrst", k=5)) for _ in range(6)]) for _ in range(60)]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(2, 4) if toxic else r.random() < 0.2):
            words.insert(r.randrange(len(words)), stem + r.choice(["en", "ig", "ar", "u", "et", "os"]))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, np.array(labels)


def test_several_forms_are_told_from_a_single_one():
    texts, labels = invented(500)
    net = toxicity.fit(texts, labels)
    assert {0, 1} <= net.margins.keys()  # both languages have enough rows
    more, truth = invented(300, seed=9)
    reader = toxicity.Reader(net)
    found = np.array([net.score(*reader.read(t)) >= 0.7 for t in more])
    assert found[truth == 1].mean() > 0.9 and found[truth == 0].mean() < 0.1


def test_margins_split_where_hits_and_misses_balance_best():
    r = np.random.default_rng(1)
    for _ in range(50):
        margins = r.integers(0, 8, 30).astype(float)
        labels, weights = r.integers(0, 2, 30), r.uniform(0.5, 3, 30)
        if not labels.any():
            continue

        def f1(cut: float) -> float:
            chosen = margins > cut
            return 2 * weights[chosen & (labels == 1)].sum() / (weights[chosen].sum() + weights[labels == 1].sum())

        best = max(f1(c - 0.5) for c in range(9))
        at = toxicity.best_margin(margins, labels, weights)
        assert f1(np.nextafter(at, -np.inf)) == pytest.approx(best)


@pytest.fixture(scope="module")
def driver_rows(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    return toxicity.scores(docs, labels).join(labels, "doc_id").collect()


def test_toxicity_is_told_on_held_out_rows(driver_rows):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in driver_rows)
    held = [r for r in driver_rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.75
    assert all(r.predicted == (r.score >= 0.7) for r in driver_rows)


def test_held_out_labels_are_never_learned(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    turned = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int"))
    held = toxicity.held_out("doc_id")
    some = docs.where("doc_id < 200")
    want = sorted(map(tuple, toxicity.scores(some, labels).collect()))
    mixed = labels.where(~held).unionByName(turned.where(held))
    assert sorted(map(tuple, toxicity.scores(some, mixed).collect())) == want


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame(
        [(200 + i, 0, i % 2) for i in range(40)] + [(201, 0, None), (None, 0, 1), (202, 0, 1), (7, 0, 1), (3, 0, 0), (99999, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert scores[3] == scores[4] == scores[5] and len(scores[7]) == 1  # no words; a repeated row
    none = toxicity.scores(docs, cases.empty(labels)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert toxicity.scores(cases.empty(docs), labels).collect() == []
