"""Sources by name, and their union."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.schema import POSTING_DDL, as_postings
from postloom.sources.issues import read_issues
from postloom.sources.pages import read_cards, read_details

Reader = Callable[[SparkSession, str], DataFrame]

READERS: dict[str, Reader] = {"issues": read_issues, "details": read_details, "cards": read_cards}


def register_source(name: str, reader: Reader) -> None:
    """Add a source: a function of (session, path) returning posting columns."""
    READERS[name.strip().lower()] = reader


def select_sources(names: Iterable[str]) -> list[str]:
    """Known sources among ``names``, in the given order; unknown names are left out."""
    wanted = (n.strip().lower() for n in names)
    return [n for n in wanted if n in READERS]


@dataclass
class Union:
    """Postings of all sources that could be read, and the names and problems of all of them."""

    postings: DataFrame
    names: list[str]
    problems: dict[str, str]

    def per_source(self, postings: DataFrame | None = None) -> DataFrame:
        """One row per configured source: (source_rank, source, ok, found, error).

        The row counts come from one aggregate.  Give the written form of ``postings`` where
        there is one, so that the sources are not read again for their counts.
        """
        lines = [
            (i, n, n not in self.problems, self.problems.get(n)) for i, n in enumerate(self.names)
        ]
        rows = self.postings if postings is None else postings
        counts = rows.groupBy("source_rank").agg(F.count(F.lit(1)).alias("found"))
        listed = rows.sparkSession.createDataFrame(
            lines, "source_rank int, source string, ok boolean, error string"
        )
        return listed.join(counts, "source_rank", "left").select(
            "source_rank", "source", "ok", F.coalesce("found", F.lit(0)).alias("found"), "error"
        )


def union_sources(
    spark: SparkSession,
    paths: dict[str, str],
    names: Iterable[str] | None = None,
    keep: Callable[[str, DataFrame], DataFrame] | None = None,
    options: dict[str, dict] | None = None,
) -> Union:
    """All postings of the selected sources, each with its ``source_rank``.

    A source that cannot be read is noted and does not stop the others.  ``keep`` (name, frame)
    writes a source's rows and returns the written table; it runs inside the guard, so that damaged
    files, which only show while rows are read, fail their own source alone.  Broken records
    inside a source are dealt with row by row by its reader.  ``options`` are given to the
    reader of that name.
    """
    frames: list[DataFrame] = []
    problems: dict[str, str] = {}
    names = select_sources(paths if names is None else names)
    for rank, name in enumerate(names):
        try:
            frame = as_postings(READERS[name](spark, paths[name], **(options or {}).get(name, {})))
            frame = keep(name, frame) if keep else frame
            frames.append(frame.withColumn("source_rank", F.lit(rank)))
        except Exception as problem:  # noqa: BLE001 - any reader may fail in its own way
            problems[name] = _first_line(problem)
    if not frames:
        empty = spark.createDataFrame([], POSTING_DDL).withColumn("source_rank", F.lit(0))
        return Union(empty, names, problems)
    union = functools.partial(DataFrame.unionByName, allowMissingColumns=True)
    return Union(functools.reduce(union, frames), names, problems)


def _first_line(problem: Exception) -> str:
    lines = [x for x in str(problem).splitlines() if x.strip()]
    return lines[0] if lines else type(problem).__name__
