from __future__ import annotations

import math
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from postloom.llm import queries, topk
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score int"


def rows(seed: int, n: int = 120):
    r = random.Random(seed)
    found = [(i, [r.uniform(-1, 1) for _ in range(6)], 0, "v", 1) for i in range(n)]
    found[7] = (7, None, 0, "v", 1)
    found[20] = (20, [], 0, "v", 1)
    found[30] = (30, [0.1, None, 0.2, 0.0, 0.0, 0.0], 0, "v", 1)
    found[31] = (31, [float("nan")] * 6, 0, "v", 1)
    found[40] = (40, [float("inf")] + [0.0] * 5, 0, "v", 1)
    found += [(1000 + i, [0.5] * 6, 0, "v", 1) for i in range(60)]  # ties
    found += [found[3], found[3], (None, [1.0] * 6, 0, "v", 1)]
    return found


def brute(rows, is_query, k):
    """All rows against all others, rows told apart by their place."""
    whole = []
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            exact = [struct.unpack("f", struct.pack("f", x))[0] for x in v]
            whole.append((vec_id, [math.floor(256 * x) for x in exact]))
    found = []
    for at, (q, a) in enumerate(whole):
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(whole) if n != at)
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("batch", [4096, 9])
def test_equals_all_scores(spark, batch):
    given = rows(0)
    df = spark.createDataFrame(given, SCHEMA).repartition(6)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, 256, batch)
    assert sorted(map(tuple, got.collect())) == brute(given, lambda q: q % 10 == 0, 5)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [float(i)], 0, "v", 1) for i in range(3)], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, 5).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]
    alone = df.where("vec_id = 1")
    assert topk.top_k(alone, F.lit(True), 5).collect() == []
    assert topk.top_k(cases.empty(df), F.lit(True), 5).collect() == []


def test_large_components_do_not_overflow_ranges(spark):
    given = [(0, [3e6, -2e6], 0, "v", 1), (1, [2e3, 1e3], 0, "v", 1), (2, [-1e6, 1e6], 0, "v", 1), (3, [1e6, 0.0], 0, "v", 1)]
    df = spark.createDataFrame(given, SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, 2).collect()))
    assert got == brute(given, lambda q: q == 0, 2)


REPEATED = [
    (0, [0.5, 0.5], 0, "v", 1), (0, [0.9, -0.5], 0, "v", 1), (0, [0.9, -0.5], 0, "v", 1), (1, [0.7, 0.1], 0, "v", 1),
    (1, [0.7, 0.1], 0, "v", 1), (50, [], 0, "v", 1), (50, [0.25], 0, "v", 1), (51, [-0.3, 0.2, 0.9], 0, "v", 1),
]


@pytest.mark.parametrize("batch", [4096, 2])
def test_rows_that_share_an_id_are_rows_of_their_own(spark, batch):
    df = spark.createDataFrame(REPEATED, SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, 256, batch)
    assert sorted(map(tuple, got.collect())) == brute(REPEATED, lambda q: q % 50 == 0, 5)


def test_query_and_sql_agree_on_repeated_ids_and_empty_vectors(spark, tmp_path):
    spark.createDataFrame(REPEATED, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.execute(queries.ORACLES["op2_exact_top_k"]).fetchall())
    got = queries.op2_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == expected


def test_plan_is_the_same_for_any_number_of_batches(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)

    def nodes(batch):
        found = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, 256, batch)
        return len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert nodes(3) == nodes(4096)
