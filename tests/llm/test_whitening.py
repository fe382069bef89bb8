"""Whitening: exact moments, eigenvectors against a plain solver, inertia counts, awkward rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from postloom.llm import whitening
from postloom.llm.shared import table
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def brute(vectors: list[list[float]]):
    """Whole numbers, exact moments and the eigenvalues of a plain solver, by loops."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    size = len(sums)
    centred = [[n * c - s for c, s in zip(v, sums)] for v in fit]
    cov = np.array([
        [float(Fraction(sum(v[i] * v[j] for v in centred), n**3)) for j in range(size)] for i in range(size)
    ])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return x, n, sums, cov, deviations


def random_symmetric(r: np.random.Generator, size: int, kind: int) -> np.ndarray:
    a = r.normal(size=(size, size))
    if kind == 0:
        return a + a.T
    if kind == 1:  # semidefinite, of low rank
        b = a[:, : max(size // 3, 1)]
        return b @ b.T
    if kind == 2:  # zero diagonal
        a = a + a.T
        return a - np.diag(np.diagonal(a))
    q = np.linalg.qr(a)[0]  # repeated eigenvalues
    return q @ np.diag(r.integers(0, 4, size).astype(float)) @ q.T


@pytest.mark.parametrize("kind", range(4))
def test_inertia_counts(kind):
    r = np.random.default_rng(kind)
    for size in (1, 2, 3, 5, 12, 40):
        v = random_symmetric(r, size, kind)
        v = (v + v.T) / 2
        values = np.linalg.eigvalsh(v)
        for at in [*r.uniform(values[0] - 1, values[-1] + 1, 20), values[0] - 1e-6, values[-1] + 1e-6]:
            if np.abs(values - at).min() > 1e-9:
                assert whitening.above(v, at) == (values > at).sum()


@pytest.mark.parametrize("kind", range(6))
def test_components_are_those_of_a_plain_solver(kind):
    r = np.random.default_rng(10 + kind)
    for size in (1, 2, 7, 20, 64, 90):
        spread = [np.linspace(1, 2, size), np.ones(size), np.r_[np.zeros(size - 1), 3.0], 2.0 ** -np.arange(size),
                  r.integers(1, 4, size).astype(float), 1 + 1e-12 * np.arange(size)][kind]
        q = np.linalg.qr(r.normal(size=(size, size)))[0]
        v = q @ np.diag(spread) @ q.T * 1e5
        v = (v + v.T) / 2
        values, vectors = whitening.components(v)
        want = np.linalg.eigvalsh(v)[::-1][:16]
        want = want[want > whitening.RANK * want[0]]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-9 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-10 * want[0]


def test_an_empty_or_constant_covariance_has_no_components():
    assert len(whitening.components(np.zeros((0, 0)))[0]) == 0
    assert len(whitening.components(np.zeros((4, 4)))[0]) == 0


def test_products_are_exact_at_every_size():
    r = np.random.default_rng(0)
    for top in (3, 10**4, 10**9, 4 * 10**18):
        z = r.integers(-top, top, (30, 5))
        exact = z.astype(object).T @ z.astype(object)
        assert (whitening.products(z) == exact).all()


def compare(spark, vectors, ids=None, wanted=16):
    ids = ids or list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids))), "vec_id long, embedding array<float>, component string")
    rows = whitening.whiten(df.repartition(3), wanted=wanted).collect()
    x, n, sums, cov, deviations = brute([np.array(v, np.float32).tolist() for v in vectors])
    values = np.linalg.eigvalsh(cov)[::-1][:wanted]
    values = values[values > whitening.RANK * values[0]] if len(values) and values[0] > 0 else []
    assert len(rows) == len(vectors) * len(values)
    found = {(r.vec_id, r.component): r for r in rows}
    trace = np.trace(cov)
    for (k, c), r in found.items():
        i = ids.index(k)
        assert r.n == n and r.deviation == (deviations[i] if deviations[i] < 2**63 else None)
        assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-6)
        assert r.identity_error < 1e-6
    if not len(values):
        return
    w = np.array([[found[k, c + 1].whitened for c in range(len(values))] for k in ids])
    mean = np.array([s / n for s in sums])
    # Distances in the whitened space do not depend on signs or on the basis of equal eigenvalues.
    q, vectors_ = np.linalg.eigh(cov)
    top = slice(len(q) - len(values), len(q))
    want = (np.array(x) - mean) @ vectors_[:, top] / np.sqrt(q[top])
    assert np.allclose(w @ w.T, want @ want.T, atol=1e-6 * max(1, np.abs(want).max() ** 2))


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(0)
    vectors = (r.normal(size=(60, 20)) * np.linspace(0.2, 3, 20)).tolist()
    compare(spark, [*vectors, *vectors[:7]])
    compare(spark, r.normal(size=(40, 3)).tolist())
    compare(spark, [[1.0, 2.0], [3.0, -4.0]])
    compare(spark, [[1e12, 2.0, 0.5], [-3e12, -4.0, 0.1], [2e11, 1.0, 7.0], [5.0, 6.0, 9.0]])


def test_awkward_rows(spark):
    r = np.random.default_rng(1)
    good = r.normal(size=(30, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(None, good[0]), (3, good[4]), (3, good[4]), (50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0])]
    rows += [(53, [float("nan")] * 5), (54, [1.0, 2.0, 3.0, 4.0, float("inf")]), (55, [1.0, 2.0]), (56, [3.0e38] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(df).collect()
    assert {r.n for r in found} == {30}
    counts = {}
    for row in found:
        counts[row.vec_id] = counts.get(row.vec_id, 0) + 1
    assert counts == {**{i: 5 for i in range(30)}, None: 5, 3: 15}
    none = {r.component: r.whitened for r in found if r.vec_id is None}
    assert none == {r.component: r.whitened for r in found if r.vec_id == 0}
    assert whitening.whiten(cases.empty(df)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).collect() == []


def test_driver_embeddings(spark):
    rows = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    found = whitening.whiten(table(spark, FOLDER, "embeddings")).collect()
    x, n, sums, cov, deviations = brute([r.embedding for r in rows])
    values, vectors = np.linalg.eigh(cov)
    want = (np.array(x) - np.array(sums) / n) @ vectors[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    order = {r.vec_id: i for i, r in enumerate(rows)}
    w = np.zeros((len(rows), 16))
    for r in found:
        w[order[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[order[r.vec_id]] and r.identity_error < 1e-9
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-7)
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose(w * signs, want, atol=1e-7)
