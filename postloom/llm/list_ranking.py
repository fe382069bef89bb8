"""Sums from the start of linked lists up to each element, distributed.

Elements point at the one before them.  Each batch of elements, sorted by id, folds the chains that lie
within it, so that only their last elements go on; where ids follow the lists, little is left after a
round or two.  What does not fold is finished by pointer jumping: every element adds the sum of the one
it points at and points at that one's target, which halves the distance to the start each round.  Every
element is pointed at by at most one other, so no join key repeats but those of a batch's own chain.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postloom.llm.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ID, BEFORE = ["a1", "a2"], ["p1", "p2"]


def _folded(size: int):
    """Chains within a batch: sums from the first element of the chain, and what that one points at."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c).to_pylist() for c in ID + BEFORE]
            place = {key: i for i, key in enumerate(zip(keys[0], keys[1]))}
            jump = np.array([*(place.get(key, n) for key in zip(keys[2], keys[3])), n])
            tail = np.ones(n + 1, bool)
            tail[jump] = False
            sums = np.zeros((n + 1, size), np.int64)
            for k in range(size):
                sums[:n, k] = batch.column(4 + k).to_numpy()
            first = np.arange(n + 1)
            while (jump[:n] < n).any():
                first = np.where(jump < n, first[jump], first)
                sums = sums + sums[jump]
                jump = jump[jump]
            head = pa.array(first[:n])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    batch.column(2).take(head), batch.column(3).take(head),
                    *(pa.array(sums[:n, k]) for k in range(size)), pa.array(tail[:n]),
                ],
                names=[*ID, *BEFORE, *(f"w{k}" for k in range(size)), "tail"],
            )

    return fold


def _jumped(links: DataFrame, weights: list[str], open_links: int) -> DataFrame:
    """Pointer jumping until nothing points anywhere."""
    while open_links:
        ahead = links.select(
            *[F.col(c).alias(f"x{k}") for k, c in enumerate(ID)],
            *[F.col(c).alias(f"next_{c}") for c in BEFORE], *[F.col(w).alias(f"ahead_{w}") for w in weights],
        )
        seen = Observation()
        links = links.join(ahead, (F.col("p1") == F.col("x0")) & (F.col("p2") == F.col("x1")), "left").select(
            *ID, *[F.col(f"next_{c}").alias(c) for c in BEFORE],
            *[(F.col(w) + F.coalesce(f"ahead_{w}", F.lit(0))).alias(w) for w in weights],
        ).observe(seen, F.count("p1").alias("open"))
        links, open_links = materialize(links, "jumped"), seen.get["open"]
    return links


def ranked(links: DataFrame, weights: list[str]) -> DataFrame:
    """(a1, a2, weights): for each element the sums of the weights from the start of its list up to it.

    ``links``: (a1, a2) is the id of an element, (p1, p2) that of the element before it, NULL at the
    start of a list; all long, ids unique, the weights not NULL.
    """
    size = len(weights)
    w = [f"w{k}" for k in range(size)]
    links = links.select(*ID, *BEFORE, *[F.col(c).alias(n) for c, n in zip(weights, w)])
    schema = ", ".join(f"{c} long" for c in ID + BEFORE + w) + ", tail boolean"
    levels: list[DataFrame] = []
    while True:
        seen = Observation()
        ordered = links.repartitionByRange(*ID).sortWithinPartitions(*ID)
        folded = ordered.mapInArrow(_folded(size), schema).observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count_if("tail").alias("tails"),
            F.count_if(F.col("tail") & F.col("p1").isNotNull()).alias("open"),
        )
        folded, counts = materialize(folded, "folded"), seen.get
        levels.append(folded)
        links = folded.where("tail").select(*ID, *BEFORE, *w)
        if not counts["open"] or counts["tails"] * 2 > counts["rows"]:
            break
    totals = _jumped(links, w, counts["open"]).select(*ID, *w)
    for level in reversed(levels):
        ends = totals.select(F.col("a1").alias("p1"), F.col("a2").alias("p2"), *[F.col(c).alias(f"end_{c}") for c in w])
        totals = level.join(ends, BEFORE, "left").select(
            *ID, *[(F.col(c) + F.coalesce(f"end_{c}", F.lit(0))).alias(c) for c in w]
        )
    return totals.select(*ID, *[F.col(n).alias(c) for c, n in zip(weights, w)])
