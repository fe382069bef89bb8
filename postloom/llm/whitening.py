"""Embedding whitening: principal components of exact integer covariances by contour integration.

Every entry c becomes the long x = floor(64 * c) + 1000000.  The covariance of the distinct x vectors is
summed exactly: tasks add products of x minus the rounded means, in integers, and only these sums (the
square of the dimension, whatever the number of rows) reach the driver.  There the largest eigenvalues
are enclosed in intervals by inertia counts (Sylvester's law on symmetric factors); FEAST iterations find
the eigenvectors of each interval: solves with the covariance shifted to complex points on a circle
around the interval, summed by quadrature, filter a subspace, Rayleigh-Ritz extracts vectors from it.
An interval is done when as many eigenvalues are found in it as the inertia counts tell.  Rows are then
centred, projected and scaled in tasks, and the whitened covariance is measured over all fit vectors.

Defined cases: rows whose vector is NULL, empty, holds a NULL or a non-finite entry, or an entry that
has no long x, take no part, nor do rows whose vector has another length than most of the distinct
vectors (ties: the longest).  Equal vectors count once in the fit; each row, also one that repeats an
id, gets its own result.  Components whose eigenvalue is below ``RANK`` of the largest have no
direction to scale and are left out: a table of one distinct vector, or an empty one, gives no rows.
``deviation`` is NULL where the exact value exceeds a long.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Largest |64 * c| that has a long x.
LIMIT = 2.0**62
# Eigenvalues smaller than this share of the largest are noise of rounding.
RANK = 1e-10
# Eigenvalues sought by one contour, quadrature points on its upper half, and the residual wanted.
IN_CONTOUR = 8
POINTS = 8
RESIDUAL = 1e-13
ITERATIONS = 60
# Whole numbers up to this are exact in doubles.
EXACT = 2.0**53


def valid(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    sound = F.forall(
        v,
        lambda c: c.isNotNull()
        & ~F.isnan(c.cast("double"))
        & (F.abs(c.cast("double") * SCALE) < LIMIT),
    )
    return F.coalesce((F.size(v) > 0) & sound, F.lit(False))


def whole_numbers(vector: str) -> Column:
    return F.transform(
        F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT)
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(z: np.ndarray) -> np.ndarray:
    """z^T z of whole numbers, exactly, as Python integers.

    Doubles hold all sums of few or small rows; large rows are added in parts, single ones that are
    larger still as Python integers.
    """
    top = float(np.abs(z).max(initial=0))
    if top * top * max(len(z), 1) < EXACT:
        d = z.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    if len(z) > 1:
        half = len(z) // 2
        return products(z[:half]) + products(z[half:])
    row = z[0].astype(object)
    return np.outer(row, row)


def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of a task: (i, n, value) per dimension."""
    n, total = 0, 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(0))
            small = float(np.abs(x).max()) * len(x) < 2.0**62
            total = total + (x if small else x.astype(object)).sum(axis=0).astype(object)
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(total)), pa.int32()),
                pa.array(np.full(len(total), n), pa.int64()),
                pa.array([str(v) for v in total]),
            ],
            names=["i", "n", "value"],
        )


# Sums of products are added in two parts of 18 digits and the rest, so that none outgrows a decimal.
PART = 10**18


def summed_products(centre: list[int]):
    """Products of x - centre summed over a task: (i, j, high, low) for i <= j."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            if batch.num_rows:
                total = total + products(matrix(batch.column(0)) - np.array(centre, np.int64))
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            values = total[i, j].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i, pa.int32()),
                    pa.array(j, pa.int32()),
                    pa.array([str(v // PART) for v in values]),
                    pa.array([str(v % PART) for v in values]),
                ],
                names=["i", "j", "high", "low"],
            )

    return add


@dataclass(frozen=True)
class Moments:
    """Exact moments: rows, sums S, and the products of x - centre summed over the rows."""

    n: int
    sums: list[int]
    centre: list[int]
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        """Each entry rounded once from its exact value."""
        rest = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        size, n = len(rest), self.n
        found = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                exact = Fraction(n * int(self.products[i, j]) - rest[i] * rest[j], n * n)
                found[i, j] = found[j, i] = float(exact)
        return found


def moments(vectors: DataFrame) -> Moments:
    """Exact moments of the vectors ``x``, which have one length."""
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    sums = vectors.select("x").mapInArrow(column_sums, "i int, n long, value string")
    rows = sorted((r.i, int(r.value), r.n) for r in sums.groupBy("i").agg(total, F.sum("n").alias("n")).collect())
    n, totals = rows[0][2], [s for _, s, _ in rows]
    centre = [round(Fraction(s, n)) for s in totals]
    parts = vectors.select("x").mapInArrow(
        summed_products(centre), "i int, j int, high string, low string"
    )
    added = parts.groupBy("i", "j").agg(
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))
    )
    found = np.zeros((len(rows), len(rows)), dtype=object)
    for r in added.collect():
        found[r.i, r.j] = found[r.j, r.i] = int(r.high) * PART + int(r.low)
    return Moments(n, totals, centre, found)


def above(v: np.ndarray, at: float) -> int:
    """Number of eigenvalues of the symmetric ``v`` greater than ``at``: its inertia shifted there.

    Symmetric factors with pivots of one or two rows, taken where the matrix is largest.
    """
    a = v - at * np.eye(len(v))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        one = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diagonal(a)))
        two = np.unravel_index(int(np.argmax(off)), off.shape) if len(a) > 1 else (0, 0)
        if diagonal[one] >= 0.6404 * off[two]:
            pivot = a[one, one]
            if pivot == 0:
                break  # nothing is left but zeros, none of them greater
            positive += int(pivot > 0)
            rest = np.delete(np.arange(len(a)), one)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, one], a[one, rest]) / pivot
        else:  # a pair of rows that counts one of each sign
            positive += 1
            pair = np.array(two)
            rest = np.delete(np.arange(len(a)), pair)
            side = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pair, pair)], side.T)
        a = (a + a.T) / 2
    return positive


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within), from the top down, that hold the ``wanted`` largest.

    An interval is halved until it holds at most ``IN_CONTOUR`` or is too narrow to be split.
    """
    # Every eigenvalue lies within a row's sum of its diagonal entry.
    top = float((np.abs(v).sum(axis=1)).max()) * (1 + 1e-12)
    found: list[tuple[float, float, int]] = []
    todo = [(-1e-9 * top, top, above(v, -1e-9 * top), 0)]
    have = 0
    while todo and have < wanted:
        low, high, over_low, over_high = todo.pop()
        count = over_low - over_high
        if not count:
            continue
        middle = (low + high) / 2
        if count > IN_CONTOUR and high - low > 1e-9 * top:
            over = above(v, middle)
            todo += [(low, middle, over_low, over), (middle, high, over, over_high)]
            continue
        found.append((low, high, count))
        have += count
    return found


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (low, high], rising, and their unit vectors, by FEAST iterations."""
    size = len(v)
    columns = min(size, 2 * count + 4)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    shifts = middle + radius * np.exp(1j * angles)
    scale = float(np.abs(v).max())
    subspace = np.random.default_rng(seed).normal(size=(size, columns))
    values, vectors = np.zeros(0), np.zeros((size, 0))
    for _ in range(ITERATIONS):
        filtered = np.zeros((size, columns))
        for weight, angle, shift in zip(weights, angles, shifts):
            solved = np.linalg.solve(shift * np.eye(size) - v, subspace.astype(complex))
            filtered += (weight / 2) * (radius * np.exp(1j * angle) * solved).real
        basis, sizes, _ = np.linalg.svd(filtered, full_matrices=False)
        basis = basis[:, sizes > 1e-14 * sizes[0]]
        ritz, turned = np.linalg.eigh(basis.T @ v @ basis)
        subspace = basis @ turned
        inside = (ritz > low) & (ritz <= high)
        values, vectors = ritz[inside], subspace[:, inside]
        residual = np.abs(v @ vectors - vectors * values).max(initial=0)
        if len(values) == count and residual <= RESIDUAL * scale * np.sqrt(size):
            return values, vectors
        if subspace.shape[1] < columns:  # directions that were lost are drawn anew
            more = np.random.default_rng(seed + 1).normal(size=(size, columns - subspace.shape[1]))
            subspace = np.column_stack([subspace, more])
    # A limit of the interval may lie on an eigenvalue, within rounding: those nearest to the middle.
    nearest = np.sort(np.argsort(np.abs(ritz - middle), kind="stable")[:count])
    values, vectors = ritz[nearest], subspace[:, nearest]
    slack = 1e-11 * scale * size
    if len(values) < count or values[0] <= low - slack or values[-1] > high + slack:
        raise ArithmeticError(f"not all of {count} eigenvalues found in ({low}, {high}]")
    return values, vectors


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    if not v.size or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scale = float(np.abs(v).max())
    scaled, values, vectors = v / scale, [], []
    for k, (low, high, count) in enumerate(intervals(scaled, min(wanted, len(v)))):
        some, own = contour(scaled, low, high, count, seed=k)
        values.append(some)
        vectors.append(own)
    found, basis = np.concatenate(values), np.column_stack(vectors)
    order = np.argsort(-found, kind="stable")[:wanted]
    order = order[found[order] > RANK * found.max()]
    # Vectors of neighbouring contours are made orthogonal to the last digit.
    basis = np.linalg.qr(basis[:, order])[0]
    ritz, turned = np.linalg.eigh(basis.T @ scaled @ basis)
    return ritz[::-1] * scale, (basis @ turned)[:, ::-1]


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole-number vectors."""
        m = self.moments
        rest = np.array([float(Fraction(s - m.n * c, m.n)) for s, c in zip(m.sums, m.centre)])
        centred = (x - np.array(m.centre, np.int64)).astype(np.float64) - rest
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly."""
        m = self.moments
        z = x - np.array(m.centre, np.int64)
        rest = np.array([s - m.n * c for s, c in zip(m.sums, m.centre)], dtype=object)
        top = m.n * int(np.abs(z).max(initial=0)) + int(np.abs(rest).max(initial=0))
        if top * top * max(z.shape[1], 1) < 2**63:
            return ((m.n * z - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((m.n * z.astype(object) - rest) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def measured(whitening: Whitening):
    """Sums of whitened fit vectors and of their products, of one task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(whitening.values)
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                w = whitening.apply(matrix(batch.column(0)))
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    return add


def identity_error(fit_list: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity."""
    size, n = len(whitening.values), whitening.moments.n
    parts = fit_list.select("x").mapInArrow(measured(whitening), "sums array<double>")
    at = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros((size + 1) * size)
    for r in at.collect():
        total[r.k] = r.v
    total = total.reshape(size + 1, size) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(size)).max())


def prepared(rows: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows that take part, with their ``x``, and the fit list of distinct ``x``."""
    named = rows.where(valid(vector)).withColumn("x", whole_numbers(vector)).drop(vector)
    distinct = materialize(named.select("x").distinct(), "fit")
    sizes = distinct.groupBy(F.size("x").alias("size")).count().collect()
    size = max(((r["count"], r["size"]) for r in sizes), default=(0, 0))[1]
    return named.where(F.size("x") == size), distinct.where(F.size("x") == size)


def fit(distinct: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None of an empty one."""
    if distinct.isEmpty():
        return None
    found = moments(distinct)
    v = found.covariance()
    values, vectors = components(v, wanted)
    trace = float(np.trace(v))
    return Whitening(found, values, vectors, values / trace if trace > 0 else values)


SCHEMA = (
    "{id} {type}, component int, n long, deviation long, "
    "whitened double, explained double, identity_error double"
)


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """One row per row that takes part and component, numbered from 1 by falling eigenvalue."""
    schema = SCHEMA.format(id=vec_id, type=rows.schema[vec_id].dataType.simpleString())
    rows = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    kept, distinct = prepared(rows, "vector")
    found = fit(distinct, wanted)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(found.values)
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            x = matrix(batch.column(1))
            deviations = np.array(found.deviations(x), dtype=object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(count), size))),
                    pa.array(np.tile(np.arange(1, size + 1), count), pa.int32()),
                    pa.array(np.full(count * size, found.moments.n), pa.int64()),
                    pa.array(np.repeat(deviations, size).tolist(), pa.int64()),
                    pa.array(found.apply(x).ravel()),
                    pa.array(np.tile(found.explained, count)),
                    pa.array(np.full(count * size, error)),
                ],
                names=[vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("id", "x").mapInArrow(project, schema)
