"""Exact top-k by score histograms: find each query's k-th best score, then select by it.

Vectors become integers, floor(scale * x).  All scores are computed in blocks; per query, a global
histogram of the scores in the current range names the bin of the k-th best, which becomes the next,
finer range, until a bin is a single score.  A last pass selects everything above that score and
the smallest ids of those equal to it.  A task only reports bins that can still hold the k-th best: its
own k-th best bin and those above, at most k counts for each query.

Queries are taken in batches of about ``batch`` rows, whose vectors are broadcast and released; the
other side is never collected, and what a task reports does not depend on its size.  Each batch's
selection is written, so that the plan is the same for any number of batches.

Defined cases: vectors that are NULL or hold NULL or non-finite components, and rows with a NULL id,
take no part; vectors of unequal length are compared with zeros for the missing components, so an
empty one scores 0; rows that repeat an id are rows of their own, each a candidate of every
other row and, where they are queries, each a query; components beyond a long saturate and sums wrap
around as longs do; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.shared import materialize
from postloom.session import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T = TypeVar("T")
BATCH = 4096
BINS = 1024
# Rows of the other side that are scored against a whole batch at once.
ROWS = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """Row number, vec_id and integer vector of every row that takes part.

    The numbers tell rows apart that share an id; they are fixed once the table is written.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: _floor(v * scale)).alias("v"),
    )


def _floor(x: Column) -> Column:
    """Largest integer not above, kept within a long."""
    inside = (x >= float(LEAST)) & (x < float(MOST))
    return F.when(inside, F.floor(x)).when(x > 0, F.lit(MOST)).otherwise(F.lit(LEAST)).cast("long")


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), _positions(sizes)] = flat
    return out[:, :width]


def _positions(sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs; in floating point where every partial sum is exact there."""
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0))
    if bound * max(queries.shape[1], 1) < 2.0**53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


class Batch:
    """One batch of queries: row numbers, ids, vectors, and the score range that holds each k-th best.

    ``low`` and ``width`` are the range's start and bin width, ``above`` the candidates over it.
    """

    def __init__(self, rows, ids, vectors, k: int, low=None, width=None):
        self.rows, self.ids, self.vectors, self.k, self.low, self.width = rows, ids, vectors, k, low, width

    def apply(self, rows: DataFrame, name: str, schema: str, act: Callable[[DataFrame], T]) -> T:
        """``act`` (an action) on what a method of this batch makes of every partition of ``rows``.

        The broadcast is released afterwards, so what ``act`` returns must not need it again.
        """
        state = (self.rows, self.ids, self.vectors, self.k, self.low, self.width)
        shared = rows.sparkSession.sparkContext.broadcast(state)
        try:
            return act(rows.mapInArrow(lambda blocks: getattr(Batch(*shared.value), name)(blocks), schema))
        finally:
            shared.destroy()

    def blocks(self, batches: Iterator[pa.RecordBatch]):
        """(ids, scores, counted) of blocks of rows; a query's own row is not counted."""
        place = np.argsort(self.rows)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = part.column(0).to_numpy()
                scores = products(self.vectors, matrix(part.column(2), self.vectors.shape[1]))
                other = np.ones(scores.shape, bool)
                at = np.searchsorted(self.rows[place], rows)
                hit = (at < len(place)) & (self.rows[place[np.minimum(at, len(place) - 1)]] == rows)
                other[place[at[hit]], np.flatnonzero(hit)] = False
                yield part.column(1).to_numpy(), scores, other

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query number, bin, count): bin BINS is everything above the range."""
        counts = np.zeros((len(self.ids), BINS + 1), np.int64)
        for _, scores, other in self.blocks(batches):
            # Ranges are unsigned distances from their start, which may exceed a long.
            away = (scores.view(np.uint64) - self.low.view(np.uint64)[:, None]) // self.width[:, None]
            inside = other & (scores >= self.low[:, None])
            bins = np.minimum(away, np.uint64(BINS)).astype(np.int64)
            query, column = np.nonzero(inside)
            flat = query * (BINS + 1) + bins[query, column]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        useful = (counts > 0) & (from_top - counts < self.k)
        query, bins = np.nonzero(useful)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(bins), pa.array(counts[query, bins])], names=["query", "bin", "n"]
        )

    def select(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query row, its id, vec_id, score) at or above the k-th best; of those equal to it the k smallest ids."""
        held: list[np.ndarray] = []
        for ids, scores, other in self.blocks(batches):
            query, column = np.nonzero(other & (scores >= self.low[:, None]))
            held.append(np.column_stack([query, ids[column], scores[query, column]]))
            if len(held) >= 16:
                held = [self._best(held)]
        best = self._best(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.rows[best[:, 0]]), pa.array(self.ids[best[:, 0]]), pa.array(best[:, 1]), pa.array(best[:, 2])],
            names=["query", "query_id", "vec_id", "score"],
        )

    def _best(self, held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
        # Descending by score without negating, which the smallest long would not survive.
        rows = rows[np.lexsort((rows[:, 1], ~rows[:, 2], rows[:, 0]))]
        _, start, sizes = np.unique(rows[:, 0], return_index=True, return_counts=True)
        return rows[_positions(sizes) < self.k] if len(rows) else rows


def _bounds(batch: Batch, rows: DataFrame) -> None:
    """Start with the widest range that scores can have: the product of the largest norms."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = float(rows.agg(F.max(F.sqrt(squares))).first()[0])
    norms = np.sqrt((batch.vectors.astype(float) ** 2).sum(axis=1))
    most = [int(longest * q * (1 + 1e-9)) + 1 for q in norms.tolist()]
    if any(m >= MOST // 2 for m in most):  # sums may wrap around
        most = [MOST] * len(most)
    batch.low = np.array([max(-m - 1, LEAST) for m in most], np.int64)
    batch.width = np.array([-(-(2 * m + 2) // BINS) for m in most], np.uint64)


def _refine(batch: Batch, rows: DataFrame) -> None:
    """Narrow every range to the single score that is the k-th best (or the lowest, if fewer)."""
    down = Window.partitionBy("query").orderBy(F.col("bin").desc())

    def reached(counts: DataFrame):
        """The first bin from the top at which k are reached; the lowest bin where fewer exist."""
        total = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        sums = total.select("query", "bin", F.sum("n").over(down).alias("n"))
        found = sums.groupBy("query").agg(
            F.max(F.when(F.col("n") >= batch.k, F.col("bin"))).alias("bin"), F.min("bin").alias("least")
        )
        return found.select("query", F.coalesce("bin", "least").alias("bin")).toPandas()

    last = False
    while not last:
        last = bool((batch.width == 1).all())
        at = batch.apply(rows, "histograms", "query long, bin long, n long", reached)
        query, bins = at["query"].to_numpy(), at["bin"].to_numpy().astype(np.uint64)
        low, width = batch.low.copy(), batch.width.copy()
        low[query] = (low[query].view(np.uint64) + bins * width[query]).view(np.int64)
        batch.low = low
        if not last:
            batch.width = -(-width.astype(object) // BINS)
            batch.width = np.maximum(np.array(batch.width, dtype=np.uint64), np.uint64(1))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, batch: int = BATCH
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, scale), "vectors")
    queries = rows.where(is_query)
    # Hashing deals row numbers evenly, so no part is much larger than ``batch``.
    parts = max(1, -(-queries.count() // batch))
    schema = "query long, query_id long, vec_id long, score long"
    folder = new_folder(spark, "selected")
    spark.createDataFrame([], schema).write.parquet(folder)  # readable also without any query
    for part in range(parts):
        some = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)
        table = some.orderBy("row").toArrow()
        if not table.num_rows:
            continue
        held = table.column(2).combine_chunks()
        one = Batch(table.column(0).to_numpy(), table.column(1).to_numpy(), matrix(held), k)
        _bounds(one, rows)
        _refine(one, rows)
        one.apply(rows, "select", schema, lambda found: found.write.mode("append").parquet(folder))
    selected = spark.read.schema(schema).parquet(folder)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = selected.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
