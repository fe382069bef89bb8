"""Running sums within groups over rows in order, however large a group is.

Rows are dealt out by ranges of (group, order), so that a group which holds a third of all rows is spread
over many tasks.  Each task sums its own stretch in one pass; what a stretch needs from those before it is
carried from one row per stretch, the only thing the driver sees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from postloom.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK = (1 << 64) - 1


def _signed(value: int) -> int:
    value &= MASK
    return value - (1 << 64) if value >> 63 else value


def _stretch(group: list[str], sums: list[str], previous: str | None):
    """Numbers, sums and previous values within the rows of one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, carried, before = None, 0, np.zeros(len(sums), np.uint64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(g).to_numpy() for g in group])
            fresh = np.ones(n, bool)
            fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            fresh[0] = last is None or tuple(keys[:, 0].tolist()) != last
            if fresh[0]:
                at, carried, before = 0, np.zeros(len(sums), np.uint64), None
            # The row where each row's group starts; -1: in an earlier batch.
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            numbers = np.arange(n) - np.maximum(start, 0) + 1 + np.where(start < 0, at, 0)
            columns = []
            for k, name in enumerate(sums):
                values = batch.column(name).to_numpy().view(np.uint64)
                total = np.cumsum(values, dtype=np.uint64)
                earlier = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
                own = np.where(start < 0, carried[k], np.uint64(0))
                upto = total - earlier[np.maximum(start, 0)] + own
                columns += [upto.view(np.int64), (upto - values).view(np.int64)]
                carried[k] = upto[-1]
            extra = [pa.array(numbers.astype(np.int64)), *map(pa.array, columns)]
            if previous:
                values = batch.column(previous).to_numpy()
                shifted = np.concatenate([[0 if before is None else before], values[:-1]])
                missing = fresh.copy()
                missing[0] = before is None
                extra.append(pa.array(shifted.astype(np.int64), mask=missing))
                before = int(values[-1])
            last, at = tuple(keys[:, -1].tolist()), int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names(batch.schema.names, sums, previous))

    return scan


def names(columns: list[str], sums: list[str], previous: str | None) -> list[str]:
    found = [*columns, "position", *(f"{p}_{s}" for s in sums for p in ("upto", "before"))]
    return [*found, "previous"] if previous else found


def _carries(tails: list, group: list[str], sums: list[str], previous: str | None) -> dict[int, tuple]:
    """What the first group of each stretch has behind it: (group, rows, sums, previous value)."""
    found: dict[int, tuple] = {}
    last, at, totals, before = None, 0, [0] * len(sums), None
    for row in sorted(tails, key=lambda r: r["stretch"]):
        first = tuple(row["first"][g] for g in group)
        if first == last:
            found[row["stretch"]] = (first, at, totals, before)
        else:
            at, totals = 0, [0] * len(sums)
        end = row["last"]
        key = tuple(end[g] for g in group)
        if key != first:
            at, totals = 0, [0] * len(sums)
        at += end["position"]
        totals = [_signed(t + end[f"upto_{s}"]) for t, s in zip(totals, sums)]
        last, before = key, end["value"] if previous else None
    return found


def _corrected(carries: dict[int, tuple], group: list[str], sums: list[str], previous: str | None):
    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretch = batch.column("stretch").to_numpy()
            columns = {name: batch.column(name) for name in batch.schema.names if name != "stretch"}
            for part in np.unique(stretch).tolist():
                if part not in carries:
                    continue
                key, at, totals, before = carries[part]
                own = stretch == part
                for name, value in zip(group, key):
                    own &= batch.column(name).to_numpy() == value
                columns["position"] = pa.array(columns["position"].to_numpy() + np.where(own, at, 0))
                for name, total in zip(sums, totals):
                    add = np.where(own, np.uint64(total & MASK), np.uint64(0))
                    for c in (f"upto_{name}", f"before_{name}"):
                        columns[c] = pa.array((columns[c].to_numpy().view(np.uint64) + add).view(np.int64))
                if previous and before is not None:
                    column = columns["previous"]
                    missing = column.is_null().to_numpy(zero_copy_only=False)
                    values = np.where(missing, before, column.fill_null(0).to_numpy())
                    columns["previous"] = pa.array(values.astype(np.int64), mask=missing & ~own)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return correct


def grouped_scan(
    df: DataFrame, group: list[str], order: list[str], sums: list[str] = [], previous: str | None = None
) -> DataFrame:
    """``df`` with, for each row in its group: ``position`` from 1 on, ``upto_x`` and ``before_x`` for each
    column x of ``sums`` (sums modulo 2^64 with and without the row itself), and ``previous``, the value of
    that column in the row before (NULL in the first).

    ``group``, ``sums`` and ``previous`` are long columns without NULLs; ``order`` may hold any.
    """
    extra = [StructField(n, LongType()) for n in names([], sums, previous)]
    stretched = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("stretch", F.spark_partition_id())
    )
    schema = StructType([*df.schema.fields, StructField("stretch", IntegerType()), *extra])
    local = materialize(stretched.mapInArrow(_stretch(group, sums, previous), schema), "scan")
    end = [*group, "position", *(f"upto_{s}" for s in sums), *([F.col(previous).alias("value")] if previous else [])]
    tails = local.groupBy("stretch").agg(
        F.min(F.struct(*group)).alias("first"), F.max(F.struct(*end)).alias("last")
    )
    carries = _carries(tails.collect(), group, sums, previous)  # one row per stretch
    out = StructType([*df.schema.fields, *extra])
    return local.mapInArrow(_corrected(carries, group, sums, previous), out)
