"""Consecutive numbers in a total order, without one task seeing all rows.

Rows are dealt out by ranges of the order and sorted within each; a row's number is its place in its range plus
the rows of the ranges before.  Only one count per range is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import materialize

RANGE, PLACE = "__range", "__place"


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted over ranges, with the range of each row and its place there.

    To be written before :func:`numbered` reads it, since rows equal in all of the order may change
    places when they are computed again.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the upper bits are the range
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({RANGE: F.spark_partition_id(), PLACE: within})
    )


def numbered(placed: DataFrame, name: str, start: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """Number the rows of a written table that came from :func:`in_ranges`.

    ``counted``: the whole table, where ``placed`` is only some of its rows.
    """
    sizes = (placed if counted is None else counted).groupBy(RANGE).agg(F.max(PLACE).alias("last"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(RANGE, (F.coalesce(F.sum(F.col("last") + 1).over(earlier), F.lit(0)) + start).alias("__before"))
    rows = placed.join(F.broadcast(offsets), RANGE)
    return rows.withColumn(name, F.col("__before") + F.col(PLACE)).drop(RANGE, PLACE, "__before")


def number_rows(df: DataFrame, name: str, *order: Column | str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` on, in ``order``; written once."""
    return numbered(materialize(in_ranges(df, *order), "in-ranges"), name, start)
