"""Connected components of a link table, without ever holding the links in one place.

Each task first folds its own links with union-find into one link per node; what is left of the
graph is then contracted by alternating large and small stars, each a map-side combined minimum
and a join, until nothing changes.
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


def fold_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links (a, b) of one batch: one link from each node to its smallest."""
    for batch in batches:
        pairs = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, index = np.unique(pairs, return_inverse=True)
        root = np.arange(len(nodes)).tolist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in index.reshape(-1, 2).tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        roots = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
        inner = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[inner]), pa.array(nodes[roots[inner]])], names=["a", "b"]
        )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    return (
        both.join(least, F.col("a") == F.col("node"))
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    hung = links.join(least, F.col("a") == F.col("node")).where(F.col("b") != F.col("least"))
    return hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    )


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, and what tells whether a round has changed them, seen while writing."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    links = links.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("checksum"))
    return materialize(links, "links"), seen.get


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component: its smallest node.

    Loops and repeated links do no harm; NULLs must not occur; no links give no rows.
    """
    links = links.select("a", "b").where("a != b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, shape = _written(links.mapInArrow(fold_links, "a long, b long").distinct())
    while shape["n"]:
        links, now = _written(_small_star(_large_star(links)).distinct())
        if now == shape:
            break
        shape = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
