"""The duplicate rule against its sequential definition."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.functions.keys import with_keys
from postloom.operators import dedupe
from tests.samples import postings


def sequential(rows):
    seen = (set(), set(), set())
    kept = []
    for seq, *keys in sorted(rows):
        if not any(k in s for k, s in zip(keys, seen)):
            kept.append(seq)
            for k, s in zip(keys, seen):
                s.add(k)
    return kept


def keyed(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, link string, fingerprint string, content_hash string")


def kept(spark, rows, **tail):
    return sorted(r.seq for r in dedupe.kept_sequence(keyed(spark, rows), **tail).collect())


def random_rows(n, values, seed):
    rng = random.Random(seed)
    order = rng.sample(range(10 * n), n)
    return [(s, *(f"{k}{rng.randrange(values)}" for k in "lfh")) for s in order]


@pytest.mark.parametrize("n, values, seed", [(1500, 900, 1), (1500, 200, 2), (800, 5, 3)])
@pytest.mark.parametrize("tail", [{"tail_after": 99}, {"tail_after": 1, "tail_rows": 10_000}])
def test_equals_the_sequential_rule(spark, n, values, seed, tail):
    rows = random_rows(n, values, seed)
    assert kept(spark, rows, **tail) == sequential(rows)


@pytest.mark.parametrize("numbers", [[0, 0, 1], [None, 0, 1], [0, 1, 0]])
def test_numbers_that_are_no_order_are_refused(spark, numbers):
    rows = [(n, f"l{i}", f"f{i}", f"h{i}") for i, n in enumerate(numbers)]
    with pytest.raises(ValueError, match="seq must number"):
        dedupe.kept_sequence(keyed(spark, rows))


def test_plan_has_no_single_partition_and_few_jobs(spark):
    group = "dedupe-jobs"
    spark.sparkContext.setJobGroup(group, group)
    found = dedupe.kept_sequence(keyed(spark, random_rows(500, 300, 9)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert "SinglePartition" not in plan and jobs < 45


def test_chain_of_conflicts_needs_many_rounds(spark):
    """Row i shares a link with i + 1 for even i and a fingerprint for odd i."""
    rows = [(i, f"l{i // 2}", f"f{(i + 1) // 2}", f"h{i}") for i in range(24)]
    assert kept(spark, rows, tail_after=99) == sequential(rows) == list(range(0, 24, 2))
    assert kept(spark, rows, tail_after=1, tail_rows=5) == sequential(rows)


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    """100,000 postings in one chain: each round of pointers doubles what is known."""
    steps = []
    for name in ("written", "materialize"):
        inner = getattr(dedupe, name)
        monkeypatch.setattr(dedupe, name, lambda df, label, *more, inner=inner: (steps.append(label), inner(df, label, *more))[1])
    n = 100_000
    rows = spark.range(n).selectExpr(
        "id AS seq", "concat('l', id div 2) AS link", "concat('f', (id + 1) div 2) AS fingerprint", "concat('h', id) AS content_hash"
    )
    found = dedupe.kept_sequence(rows, tail_rows=0)
    assert found.where("seq % 2 = 1").count() == 0 and found.distinct().count() == n // 2
    assert steps.count("dedupe-open") - 1 <= 4 and len(steps) <= 30


def test_chains_that_branch_and_meet(spark):
    """Postings that come after two others, third in a group, or after one they share two keys with."""
    rng = random.Random(8)
    for values in (4, 9, 25):
        rows = [(i, f"l{i // 2 if rng.random() < 0.7 else rng.randrange(values)}", f"f{(i + 1) // 2}", f"h{rng.randrange(values * 9)}") for i in range(300)]
        assert kept(spark, rows, tail_after=0, tail_rows=0) == sequential(rows)


def test_one_key_held_by_a_third_of_all_rows(spark):
    rng = random.Random(4)
    rows = [
        (i, f"l{rng.randrange(3000)}", "hot" if i % 3 == 0 else f"f{rng.randrange(2000)}", f"h{rng.randrange(2500)}")
        for i in range(3000)
    ]
    assert kept(spark, rows) == sequential(rows)


def test_missing_keys_count_as_equal(spark):
    rows = [(i, None, f"f{i}", f"h{i}") for i in range(30)] + [(40, "a", None, "x"), (41, "b", None, "y")]
    assert kept(spark, rows, tail_after=99) == sequential(rows) == [0, 40]


small_rows = st.lists(st.tuples(*[st.integers(0, 3)] * 3), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(small_rows)
def test_small_batches(spark, keys):
    rows = [(i, *map(str, k)) for i, k in enumerate(keys)]
    assert kept(spark, rows) == sequential(rows)


def test_fingerprint_ignores_accents_and_content_hash_sees_the_text(spark):
    df = with_keys(
        postings(
            spark,
            {"title": "Líder Kafka Sênior"},
            {"title": "Líder Kafka Senior", "link": "https://example.com/jobs/2"},
            {"title": "Líder Kafka Senior", "description": "Other text"},
            {"title": "Líder Kafka Senior", "stack": ["Docker", "PostgreSQL"]},
        )
    )
    a, b, c, d = df.orderBy("seq").collect()
    assert a.fingerprint == b.fingerprint == c.fingerprint and a.content_hash == b.content_hash
    assert b.content_hash != c.content_hash and d.content_hash == b.content_hash
    assert len(a.fingerprint) == 64


def test_filter_new(spark):
    """One stored posting and three that share a fingerprint: one is new."""
    stored = with_keys(postings(spark, {"link": "https://example.com/jobs/existing"})).withColumn("created_at", F.current_timestamp())
    batch = postings(
        spark,
        {"link": "https://example.com/jobs/existing"},
        {"link": "https://example.com/jobs/2", "company": "OtherCo"},
        {"link": "https://example.com/jobs/2?x=1", "company": "OtherCo"},
        {"link": "https://other.example/jobs/abc", "company": "OtherCo"},
    )
    assert [r.seq for r in dedupe.filter_new(batch, stored).collect()] == [1]


@pytest.mark.parametrize("small", [True, False])
def test_existing_keys(spark, small):
    store = spark.createDataFrame(
        [("a", "2026-01-01"), ("a", "2026-01-01"), ("b", "2026-02-01"), ("", "2026-02-01"), (None, "2026-02-01"), ("d", "2026-02-01")],
        "link string, day string",
    ).withColumn("created_at", F.to_timestamp("day"))
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,), ("c",)], "link string")
    find = lambda **k: sorted(r.link for r in dedupe.existing_keys(store, keys, "link", small=small, **k).collect())
    assert find() == ["a", "b"]
    assert find(as_of="2026-02-03", window_days=7) == ["b"]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_find_duplicates_never_pairs_rows(spark):
    rows = random_rows(300, 40, 5)
    store, new = keyed(spark, rows[:150]), keyed(spark, rows[150:])
    found = dedupe.find_duplicates(store, new)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    sets = [{r[i] for r in rows[150:]} for i in (1, 2, 3)]
    wanted = {r[0] for r in rows[:150] if any(r[i + 1] in sets[i] for i in range(3))}
    assert {r.seq for r in found.collect()} == wanted and found.count() == len(wanted)


def test_hot_key_is_split_by_adaptive_execution(spark):
    """The lookup of taken keys may meet a hot key: its partition must be read by many tasks."""
    settings_now = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings_now}
    for k, x in settings_now.items():
        spark.conf.set(k, x)
    try:
        digest = F.sha2(F.col("id").cast("string"), 256)
        rows = spark.range(0, 60_000, numPartitions=16).select(
            F.col("id").alias("seq"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(digest).alias("link"),
            digest.alias("fingerprint"),
        )
        taken = spark.range(5000).select(digest.alias("link"))
        plan = final_plan(rows.join(taken, "link", "left_anti").select(F.max("fingerprint")))
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_duplicates_are_told_per_posting(spark):
    stored = spark.createDataFrame(
        [(1, "a", "f", "h"), (2, "b", "f", None), (3, "c", "", "h2"), (4, "d", "f", "h")],
        "id long, link string, fingerprint string, content_hash string",
    )
    batch = keyed(spark, [(10, "a", "f", "x"), (11, "z", "", "h2"), (12, "z", None, None), (13, "d", "g", "h")])
    found = sorted(map(tuple, dedupe.duplicates_by_posting(stored, batch).collect()))
    assert found == [(10, 1, 1, 3, 1, 0, None), (11, 0, None, 0, None, 1, 3), (13, 1, 4, 0, None, 2, 1)]
    assert dedupe.duplicates_by_posting(stored.limit(0), batch).collect() == []
