"""Reads on the store: top, recent, lookup, summary and the output projections."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _within(limit: int, low: int, high: int | None = None) -> int:
    """The limit, if it is in its range; only settings with a range of their own have an upper end."""
    if limit < low or (high is not None and limit > high):
        raise ValueError(f"limit must be at least {low}" + (f", at most {high}" if high else ""))
    return limit


def recent_jobs(store: DataFrame, limit: int = 50) -> DataFrame:
    return store.orderBy(F.desc_nulls_first("created_at"), "link").limit(_within(limit, 1))


def top_jobs(store: DataFrame, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """Best scores first, then the most recently seen; the link breaks the remaining ties.

    The bound is rounded up to the two decimals of the score, so that it is compared without a
    cast and reaches the scan.
    """
    bound = Decimal(str(min_score)).quantize(Decimal("0.01"), ROUND_CEILING)
    return (
        store.filter(F.col("score") >= F.lit(bound).cast("decimal(5,2)"))
        .orderBy(F.desc("score"), F.desc_nulls_first("last_seen_at"), "link")
        .limit(_within(limit, 1))
    )


def top_by(scored: DataFrame, keys: tuple[str, ...], limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """The best of each group with their ``rank``; equal scores go by the link.

    The rank filter becomes a group limit inside the map tasks, so of a group only ``limit`` rows per
    task are shuffled.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("link"), F.asc("seq"))
    ranked = scored.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= _within(limit, 1))


def top_payloads(payloads: DataFrame, limit: int = 10, min_score: float = 50.0) -> DataFrame:
    """Dry run: the same over payloads not stored yet; equal scores stay in order of arrival."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    return (
        payloads.filter(score >= min_score).orderBy(score.desc(), F.asc("seq")).limit(limit)
    )


def job_by_id(store: DataFrame, job_id) -> DataFrame:
    """The stored row with this id; an empty frame when there is none."""
    return store.filter(F.col("id") == job_id)


def recent_executions(log: DataFrame, limit: int = 25) -> DataFrame:
    return log.orderBy(F.desc_nulls_first("started_at"), F.desc("id")).limit(_within(limit, 1, 100))


def metrics_summary(store: DataFrame) -> DataFrame:
    """One row: number of jobs, best score (0 without any), last sighting."""
    return store.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.coalesce(F.max("score").cast("double"), F.lit(0.0)).alias("top_score"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def recently_seen(store: DataFrame, limit: int = 20) -> DataFrame:
    columns = ("id", "title", "company", "score", "seen_count", "last_seen_at")
    return (
        store.orderBy(F.desc_nulls_first("last_seen_at"), "link").select(*columns).limit(limit)
    )


def per_source_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count(F.lit(1)).alias("jobs"))


def cap_per_source(postings: DataFrame, limit: int = 30) -> DataFrame:
    """At most ``limit`` rows per source in order of arrival.

    Ranked per source with a rank filter, which Spark turns into a group limit inside every map
    task: of a source holding a third of all rows only ``limit`` rows per task are shuffled.
    """
    _within(limit, 1, 100)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return postings.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


# --- projections -----------------------------------------------------------------------------------


def project_job_read(store: DataFrame) -> DataFrame:
    return store.select(
        "id", "title", "company", "location", "stack", "link", "source", "seniority",
        F.col("score").cast("double").alias("score"), "score_reasons", "remote_type",
        "contract_type", F.col("salary_min").cast("double").alias("salary_min"),
        F.col("salary_max").cast("double").alias("salary_max"), "created_at", "updated_at",
    )


def project_job_dict(store: DataFrame) -> DataFrame:
    """All stored columns but the raw payload, decimals as doubles."""
    decimals = {c: F.col(c).cast("double") for c in ("score", "salary_min", "salary_max")}
    return store.withColumns(decimals).select(
        "id", "title", "company", "location", "stack", "link", "source", "external_id",
        "fingerprint", "content_hash", "published_at", "seniority", "score", "score_reasons",
        "salary_min", "salary_max", "salary_currency", "contract_type", "remote_type", "country",
        "city", "status", "seen_count", "last_seen_at", "created_at", "updated_at",
    )


def project_execution_read(log: DataFrame) -> DataFrame:
    return log.select(
        "id", "started_at", "finished_at", "sources_scraped", "jobs_found", "jobs_new", "status",
        "error_message",
    )
