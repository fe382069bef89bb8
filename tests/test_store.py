"""The versioned store: buckets that split, its key index, lookups that read only their buckets."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.operators import dedupe
from postloom.sources import buckets, store

NOW = dt.datetime(2026, 6, 1)
COLUMNS = "id long, link string, title string, fingerprint string, content_hash string, score double, seen_count int, last_seen_at timestamp, updated_at timestamp, created_at timestamp"


def batch_of(spark, rows):
    """(id, link number, version of the keys) per row."""
    made = [(i, f"https://x.example/{n}", f"t{i}", f"f{n % 50}-{k}", f"c{n}-{k}", float(n % 7)) for i, n, k in rows]
    return spark.createDataFrame(made, "id long, link string, title string, fingerprint string, content_hash string, score double")


def empty_of(spark):
    return spark.createDataFrame([], COLUMNS)


def put(spark, path, rows, version, day=0, **settings):
    return store.upsert_store(spark, path, batch_of(spark, rows), empty_of(spark), NOW + dt.timedelta(days=day), version, **settings)


def files_read(df) -> int:
    """Buckets of the store that a frame reads."""
    return len({re.sub(r"/[^/]*$", "", f) for f in df.inputFiles() if "/modulus=" in f})


def index_rows(spark, path):
    read = buckets.read_slots(spark, store.directories(spark, path)["keys"])
    return sorted(map(tuple, read.select("kind", "key", "link", "id").collect()))


def test_another_number_of_buckets_finds_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    put(spark, path, [(i, i, 0) for i in range(200)], 1, buckets=4)
    told = put(spark, path, [(1000 + i, 190 + i, 1) for i in range(20)], 2, 1, buckets=32)
    assert told == {"affected": 20, "inserted": 10, "updated": 10}
    rows = store.current_store(spark, path).collect()
    assert len(rows) == len({r.link for r in rows}) == 210
    assert {s.modulus for s in store.directories(spark, path)["data"]} == {4}


def test_buckets_split_without_a_lost_or_doubled_link(spark, tmp_path):
    path, r = str(tmp_path / "s"), random.Random(1)
    model: dict[int, tuple] = {}
    for version in range(1, 5):
        links = r.sample(range(1000), 40 * version**2)
        told = put(spark, path, [(version * 10_000 + k, n, version) for k, n in enumerate(links)], version, version, buckets=4, bucket_rows=40)
        assert told["inserted"] == sum(n not in model for n in links)
        for k, n in enumerate(links):
            model[n] = (model[n][0] if n in model else version * 10_000 + k, version)
        slots = store.directories(spark, path)["data"]
        # The slots divide all hashes, and each one's rows are its own.
        assert sum(1 / s.modulus for s in slots) == 1
        assert sum(s.rows for s in slots) == len(model)
    assert len(slots) >= 16
    rows = {r.link: r for r in store.current_store(spark, path).collect()}
    assert len(rows) == store.current_store(spark, path).count() == len(model)
    for n, (first, version) in model.items():
        row = rows[f"https://x.example/{n}"]
        assert (row.id, row.content_hash) == (first, f"c{n}-{version}")
    expected = sorted(
        (kind, key, f"https://x.example/{n}", first) for n, (first, k) in model.items()
        for kind, key in (("id", str(first)), ("fingerprint", f"f{n % 50}-{k}"), ("content_hash", f"c{n}-{k}"))
    )
    assert index_rows(spark, path) == expected


def test_a_large_first_batch_is_written_by_its_size(spark, tmp_path):
    path = str(tmp_path / "s")
    put(spark, path, [(i, i, 0) for i in range(3000)], 1, buckets=64, bucket_rows=20)
    slots = store.directories(spark, path)["data"]
    assert {s.modulus for s in slots} >= {128, 256}  # from 64 buckets to about 200
    assert max(s.rows for s in slots) <= 50 and store.current_store(spark, path).count() == 3000


def test_placing_covers_mixed_moduli(spark):
    slots = [buckets.Slot(2, 0), buckets.Slot(4, 1), buckets.Slot(8, 3), buckets.Slot(8, 7)]
    rows = spark.range(-500, 500).withColumn("h", F.xxhash64("id"))
    placed = buckets.placed(rows, slots, F.col("h")).collect()
    assert len(placed) == 1000 and all(r.h % r.modulus == r.bucket for r in placed)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    put(spark, path, [(i, i, 0) for i in range(400)], 1, buckets=32)
    put(spark, path, [(1000 + i, i, 1) for i in range(0, 400, 100)], 2, 9)
    return path


def test_a_job_by_id_reads_one_bucket_of_rows(spark, filled):
    found = store.job_by_id(spark, filled, 100)
    assert [(r.id, r.link, r.content_hash) for r in found.collect()] == [(100, "https://x.example/100", "c100-1")]
    assert files_read(found) == 1
    assert files_read(store.current_store(spark, filled)) > 20
    index = store.entries_of(spark, filled, spark.createDataFrame([("id", "100")], "kind string, key string"))
    assert files_read(index) == 1
    missing = store.job_by_id(spark, filled, 99_999)
    assert missing is None or missing.collect() == []


@pytest.mark.parametrize("key", dedupe.KEYS)
def test_keys_by_index_are_those_of_the_scan(spark, filled, key):
    keys = batch_of(spark, [(1, 5, 0), (2, 100, 0), (3, 100, 1), (4, 4000, 0), (5, 7, 3)])
    keys = keys.unionByName(keys.limit(1).withColumns({k: F.lit(None).cast("string") for k in dedupe.KEYS})).unionByName(
        keys.limit(1).withColumns({k: F.lit("") for k in dedupe.KEYS})
    )
    whole = store.current_store(spark, filled)
    for window in ({}, {"as_of": NOW + dt.timedelta(days=9), "window_days": 5}):
        got = store.existing_keys(spark, filled, keys, key, **window)
        want = dedupe.existing_keys(whole, keys, key, **window)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert files_read(store.existing_keys(spark, filled, keys.limit(1), key)) == 1


def test_a_batch_is_filtered_through_the_index(spark, filled):
    postings = batch_of(spark, [(1, 5, 0), (2, 100, 0), (3, 600, 1), (4, 4000, 0), (5, 4001, 9)]).withColumn("seq", F.col("id"))
    got = store.filter_new(spark, filled, postings).select("seq").collect()
    want = dedupe.filter_new(postings, store.current_store(spark, filled)).select("seq").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 1


def test_lookups_in_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    keys = batch_of(spark, [(1, 5, 0)])
    assert store.job_by_id(spark, path, 1) is None
    for key in dedupe.KEYS:
        assert store.existing_keys(spark, path, keys, key).collect() == []
    assert put(spark, path, [], 1) == {"affected": 0, "inserted": 0, "updated": 0}
    assert store.current_store(spark, path) is None
