"""Inputs of the queries: how rows are dealt over tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import inputs
from postloom import session
from postloom.functions import batches, keys
from postloom.functions.text import normalize_text, normalized
from postloom.plans import daily_run


def test_one_row_group_is_work_for_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one.parquet")
    spark.range(1000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 100).alias("text")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(inputs, "TASK_ROWS", 20)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits, of which one has all rows
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in inputs.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 20


def test_tasks_of_text_work_do_not_grow_with_the_table(spark):
    """A task gets at most a thousand rows, so its time is that of these rows, whatever the size of the table."""
    assert inputs._tasks(spark.range(200_000)) >= 200
    assert inputs._tasks(spark.range(400_000)) == 2 * inputs._tasks(spark.range(200_000))


def test_texts_in_order_are_left_as_they_are(spark):
    texts = ["", " ", "a b", " a", "a ", "a  b", "a\tb", "a b", " ", "é ü", "a\x85", "\x7f ~", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(normalized(F.col("t")), normalize_text(F.col("t"))).collect()
    assert [a for a, _ in got] == [b for _, b in got]


def test_letters_that_may_decompose(spark):
    df = spark.createDataFrame([(t,) for t in ("plain", "ßøł–", "ﬁne", "한", "½", "a\x7f")], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(keys.FOREIGN)).collect()] == [False, True, True, True, True, False]


def test_parts_are_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 5)
    rows = inputs.landed_postings(spark, "/root/testdata/sf0.001", 3)
    found = [tuple(r) for r in rows.select("seq", "part", F.spark_partition_id()).collect()]
    seqs = [s for s, _, _ in found]
    assert len(found) == 200 and seqs == sorted(seqs) and [p for _, p, _ in found] == sorted(p for _, p, _ in found)
    assert {p for _, p, _ in found} == {0, 1, 2} and len({i for _, _, i in found}) > 30


def test_pages_are_read_some_at_a_time(monkeypatch):
    at_once = []
    read = batches.read_pages({"h1": [{"tag": "h1"}]}, {})

    class Pages:
        def __init__(self, texts):
            self.texts = texts

        def __len__(self):
            return len(self.texts)

        def slice(self, start, length):
            return Pages(self.texts[start : start + length])

        def to_pylist(self):
            at_once.append(len(self.texts))
            return self.texts

    got = read(Pages([f"<h1>{i}</h1>" for i in range(200)] + [None]))
    assert [r["h1"] for r in got.to_pylist()] == [*map(str, range(200)), None]
    assert max(at_once) == batches.PAGES and len(read(Pages([]))) == 0


def test_a_run_writes_its_postings_once_before_they_are_scored(spark, tmp_path, monkeypatch):
    line = '{"id": 1, "number": %d, "title": "Python Dev @ Acme", "body": "Django", "html_url": "https://x.example/jobs/%d", "state": "open"}'
    (tmp_path / "a.json").write_text("\n".join(line % (i, i) for i in (1, 2)), encoding="utf-8")
    names = []

    def named(df, name, *by):
        names.append(name)
        return session.materialize(df, name, *by)

    monkeypatch.setattr(daily_run, "materialize", named)
    settings = daily_run.RunSettings(paths={"issues": str(tmp_path)}, now=dt.datetime(2026, 6, 1))
    assert daily_run.run(spark, settings, dry_run=True).summary.first().jobs_found == 2
    assert names == ["source-issues", "checked"]
