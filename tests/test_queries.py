"""Every registered query against its SQL over the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.compare import connect, difference, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = spark_rows(driver.queries()[name](spark, FOLDER))
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        assert difference(got, duck_rows(duck, sql)) == ""


def test_stream_equals_the_batch_run(spark):
    """All postings land in one file, so the stream has one batch: the deduplicated postings."""
    stream = spark_rows(driver.queries()["incremental_ingest"](spark, FOLDER).select("link"))
    batch = spark_rows(driver.queries()["dedupe_batch"](spark, FOLDER).select("link"))
    assert stream == batch


def test_entry(spark):
    best = driver.entry(spark)
    assert best.columns == ["seq", "title", "company", "link", "score", "matched"] and best.count() == 10


def test_python_is_only_used_for_keys_and_pages(spark):
    for name in ("detect_stack", "score_postings", "parse_location", "canonicalize_url", "chunk_by_lines", "collect_links"):
        plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan, name
    for name in ("fingerprint", "parse_listing_card", "parse_detail_page", "visible_text"):
        plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_scans_read_only_what_is_needed(spark):
    plan = driver.queries()["per_source_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan
