"""The daily run: sources to stored, scored postings, a report and a log entry."""

from __future__ import annotations

import datetime as dt
import traceback
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.dedupe import SMALL_BATCH_ROWS, dedupe_batch
from postloom.operators.postings import with_errors
from postloom.operators.report import daily_report, report_gate
from postloom.operators.scoring import build_payloads
from postloom.operators.serve import cap_per_source, top_jobs, top_payloads
from postloom.operators.store import (
    payload_defaults,
    run_log_create,
    run_log_finish,
    run_status,
    upsert_counts,
    upsert_postings,
)
from postloom.profile import MatchProfile
from postloom.session import materialize, written
from postloom.sources.registry import union_sources
from postloom.sources.store import current_store, log_events, upsert_store


@dataclass(frozen=True)
class RunSettings:
    paths: dict[str, str]
    now: dt.datetime
    run_id: int = 1
    sources: tuple[str, ...] | None = None
    profile: MatchProfile = field(default_factory=MatchProfile)
    order: tuple[Column, ...] = ()  # arrival order within a source; default: order of the files
    max_per_source: int | None = None  # the reader's own cap, 1 to 100; None reads everything
    reader_options: dict[str, dict] = field(default_factory=dict)  # by source, e.g. state and age
    store: str | None = None  # folder of the versioned store and its log
    send_empty_report: bool = False
    finished: dt.datetime | None = None  # closing time in the log; default: when the run is over


@dataclass
class RunResult:
    summary: DataFrame
    top: DataFrame
    rejects: DataFrame
    snapshot: DataFrame | None = None
    report: DataFrame | None = None


def process(postings: DataFrame, profile: MatchProfile) -> DataFrame:
    """Deduplicate first, so that dropped rows are never scored."""
    return build_payloads(dedupe_batch(postings), profile)


def empty_snapshot(payloads: DataFrame, now) -> DataFrame:
    shaped = payload_defaults(payloads.withColumn("id", F.col("seq")), now)
    shaped = shaped.withColumn("created_at", F.col("updated_at"))
    return shaped.drop("seq", "source_rank").limit(0)


def run_summary(status: DataFrame, counts: DataFrame, run: str = "id") -> DataFrame:
    """One row per run: sources, found, new (inserted plus updated), status and errors."""
    return status.join(counts, run)


PLACE = (F.asc_nulls_first, ("landed_file", "landed_row", "link", "title"))


def numbered(postings: DataFrame, *order: Column) -> DataFrame:
    """Give every posting its ``seq``: sources in turn, then by ``order``, else by file and position.

    A distributed range sort puts the rows in order over the partitions, and the generated id
    grows with partition and row.  Which files are read together, or how large they are, has no
    influence.  Write the result before it is used: rows that are equal in all of the order may
    change places when they are computed again.
    """
    if not order:
        ascending, names = PLACE
        order = tuple(ascending(n) for n in names if n in postings.columns)
    rank = ["source_rank"] if "source_rank" in postings.columns else ["source"]
    return postings.drop("seq").orderBy(*rank, *order).withColumn("seq", F.monotonically_increasing_id())


def run(
    spark: SparkSession, settings: RunSettings, snapshot: DataFrame | None = None, dry_run: bool = False
) -> RunResult:
    """Read, validate, deduplicate, score, upsert, report; with a store also log and publish.

    ``seq`` is the position in the ingested table: it is written once and then read, so it stays
    the same however often a later stage is recomputed.  A dry run ends before the store.  A run
    on a store opens a log entry first and closes it last, as failed if anything goes wrong; the
    new version is published in one step, so a failed run leaves the store as it was.
    """
    if settings.store is None or dry_run:
        return _run(spark, settings, snapshot, dry_run)
    opened = spark.range(1).select(F.lit(settings.run_id).alias("id"), F.lit(settings.now).cast("timestamp").alias("started_at"))
    log_events(settings.store, run_log_create(opened))
    closing = "id", "finished_at", "sources_scraped", "jobs_found", "jobs_new", "status", "error_message"
    finished = F.current_timestamp() if settings.finished is None else F.lit(settings.finished).cast("timestamp")
    try:
        result = _run(spark, settings, snapshot, dry_run)
        done = result.summary.withColumnRenamed("affected", "jobs_new").withColumn("finished_at", finished)
        log_events(settings.store, run_log_finish(done.select(*closing)))
        return result
    except Exception as problem:
        failed = spark.range(1).select(
            F.lit(settings.run_id).alias("id"), finished.alias("finished_at"), F.lit(0).alias("sources_scraped"),
            F.lit(0).alias("jobs_found"), F.lit(0).alias("jobs_new"), F.lit("failed").alias("status"),
            F.lit(f"{problem}\n{traceback.format_exc()}").alias("error_message"),
        )
        log_events(settings.store, run_log_finish(failed))
        raise


def _run(
    spark: SparkSession, settings: RunSettings, snapshot: DataFrame | None, dry_run: bool
) -> RunResult:
    found = union_sources(
        spark, settings.paths, settings.sources,
        lambda name, frame: materialize(frame, f"source-{name}"), settings.reader_options,
    )
    landed = numbered(found.postings, *settings.order)
    if settings.max_per_source:
        landed = cap_per_source(materialize(landed, "ingested"), settings.max_per_source)
    # Numbered and validated once, written by outcome, and read from there by all that follows.
    checked = materialize(with_errors(landed), "checked", "valid")
    per_source = found.per_source(checked).withColumn("id", F.lit(settings.run_id))
    status = run_status(per_source, "id")
    valid, rejects = checked.filter("valid").drop("valid", "errors"), checked.filter("not valid").drop("valid")
    payloads, arrived = written(process(valid.drop("landed_file", "landed_row"), settings.profile), "payloads")

    def counted(affected: int, inserted: int) -> DataFrame:
        return spark.range(1).select(
            F.lit(settings.run_id).alias("id"), F.lit(affected).cast("bigint").alias("affected"),
            F.lit(inserted).cast("bigint").alias("inserted"), F.lit(affected - inserted).cast("bigint").alias("updated"),
        )

    if dry_run:
        top = top_payloads(payloads, min_score=settings.profile.min_score)
        summary = run_summary(status, counted(arrived, arrived)).withColumn("status", F.lit("dry_run"))
        return RunResult(summary, top, rejects)

    if settings.store is not None:
        snapshot = current_store(spark, settings.store)
    empty = empty_snapshot(payloads, settings.now)
    snapshot = empty if snapshot is None else snapshot
    batch = payloads.withColumn("id", F.col("seq") + _next_id(snapshot)).drop("seq", "source_rank")
    if settings.store is not None:
        changed = upsert_store(spark, settings.store, batch, empty, settings.now, settings.run_id)
        counts = counted(changed["affected"], changed["inserted"])
        updated = current_store(spark, settings.store)
        updated = empty if updated is None else updated
    else:
        counts = materialize(upsert_counts(snapshot, batch).withColumn("id", F.lit(settings.run_id)), "counts")
        updated = upsert_postings(snapshot, batch, settings.now, arrived <= SMALL_BATCH_ROWS)
        updated = materialize(updated, "snapshot")
    top = top_jobs(updated, 10, settings.profile.min_score)
    report = daily_report(top, arrived, settings.now.date()).withColumn(
        "notification_status", report_gate(F.col("jobs"), settings.send_empty_report)
    )
    return RunResult(run_summary(status, counts), top, rejects, updated, report)


def _next_id(snapshot: DataFrame) -> int:
    last = snapshot.agg(F.max("id")).first()[0]
    return 0 if last is None else last + 1
