"""State of the store: upserts, sightings, marks and the run log.

The store is a table of immutable snapshots; ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.schema import BUSINESS_COLUMNS


def _at(now) -> Column:
    return F.lit(now).cast("timestamp")


def payload_defaults(batch: DataFrame, now) -> DataFrame:
    """Fill status, seen_count, last_seen_at and updated_at where a payload lacks them."""
    defaults = {
        "status": F.lit("active"),
        "seen_count": F.lit(1),
        "last_seen_at": _at(now),
        "updated_at": _at(now),
    }
    return batch.withColumns(
        {n: F.coalesce(F.col(n), d) if n in batch.columns else d for n, d in defaults.items()}
    )


STATE = ("seen_count", "last_seen_at", "created_at", "updated_at")


def upsert_postings(
    snapshot: DataFrame, batch: DataFrame, now, small_batch: bool = False
) -> DataFrame:
    """Next snapshot: insert by link, or replace the business columns and count the sighting.

    Both sides hold every link once; a batch that does not fails.  A matched row keeps id, link and
    created_at.  New rows take
    the id the batch brings.  By default one full outer join on link.  For a batch known to be
    small (``small_batch``, to be set by a count) only its links are broadcast: stored rows with
    other links pass through where they lie, and just the touched rows are joined.
    """
    check_unique(batch)
    if not small_batch:
        return merge_rows(snapshot, batch, now)
    links = F.broadcast(batch.select("link"))
    untouched = snapshot.join(links, "link", "left_anti")
    touched = snapshot.join(links, "link", "left_semi")
    merged = merge_rows(touched, batch, now)
    return untouched.select(*merged.columns).unionByName(merged)


def merge_rows(snapshot: DataFrame, batch: DataFrame, now, *marks: str) -> DataFrame:
    """The full outer join of an upsert; ``marks`` names two flags: was stored, is in the batch."""
    columns = [c for c in ("id", "link", *BUSINESS_COLUMNS, *STATE) if c in snapshot.columns]
    incoming = payload_defaults(batch, now)
    values = F.struct(*[c for c in incoming.columns if c != "link"]).alias("new")
    known = snapshot.withColumn("__stored", F.lit(True))
    both = known.join(incoming.select("link", values), "link", "full_outer")
    stored, arrived = F.col("__stored").isNotNull(), F.col("new").isNotNull()
    again = stored & arrived

    update = {
        c: F.when(arrived, F.col(f"new.{c}")).otherwise(F.col(c))
        for c in columns
        if c in BUSINESS_COLUMNS and c in incoming.columns
    }
    update["id"] = F.coalesce("id", "new.id")
    update["created_at"] = F.when(stored, F.col("created_at")).otherwise(_at(now))
    update["seen_count"] = (
        F.when(again, F.col("seen_count") + 1).otherwise(F.coalesce("seen_count", "new.seen_count"))
    )
    for c in ("last_seen_at", "updated_at"):
        update[c] = F.when(again, _at(now)).otherwise(F.coalesce(c, f"new.{c}"))
    flags = [c.alias(n) for c, n in zip((stored, arrived), marks)]
    return both.withColumns(update).select(*columns, *flags)


def check_unique(batch: DataFrame) -> None:
    """Fail where a batch holds a link twice, which would be stored twice."""
    rows, links = batch.agg(F.count(F.lit(1)), F.count_distinct("link")).first()
    if rows != links:
        raise ValueError(f"a batch holds every link once: {rows} rows have {links} different links")


def upsert_counts(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: inserted, updated, and affected, their sum (what a run reports as "new")."""
    known = batch.select("link").join(
        snapshot.select("link").withColumn("known", F.lit(1)), "link", "left"
    )
    return known.agg(
        F.count(F.lit(1)).alias("affected"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("inserted"),
        F.count("known").alias("updated"),
    )


def fold_sightings(
    sightings: DataFrame, key: str = "link", seen_at: str = "seen_at", order: str = "seq",
    first: str = "created_at", last: str = "last_seen_at", count: str = "seen_count",
) -> DataFrame:
    """Append-only sightings to one row per key: latest values, first and last sighting, count.

    The append-only way to the state an upsert keeps.  Only (key, time, order) is aggregated, by
    hash and combined map-side, so a key seen in a third of all rows is one row per map task
    when it is shuffled; the wide rows are joined once with the place of the latest of their key and
    never sorted by an aggregation.  Sightings of the same time go by ``order``, which is an integer
    and tells the sightings of a key and time apart.
    """
    # Time and order as one number, so that its maximum needs no struct (and with it no sorting).
    micros = F.coalesce(F.unix_micros(F.col(seen_at).cast("timestamp")), F.lit(-(10**17))).cast("decimal(38,0)")
    place = micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(order)
    at = sightings.withColumn("__place", place.cast("decimal(38,0)"))
    folded = at.groupBy(F.col(key).alias("__key")).agg(
        F.max("__place").alias("__last"),
        F.min(seen_at).alias("__first_at"),
        F.max(seen_at).alias("__last_at"),
        F.count(F.lit(1)).alias("__count"),
        F.min(order).alias("first_seq"),
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__place") == F.col("__last"))
    kept = [c for c in sightings.columns if c not in (key, seen_at, first, last, count)]
    return at.join(folded, same).select(
        key, *kept, F.col("__first_at").alias(first), F.col("__last_at").alias(last),
        F.col("__count").alias(count), "first_seq",
    )


def snapshot_of(sightings: DataFrame) -> DataFrame:
    """Store rows from scored sightings: a link's id is the number of its first sighting."""
    folded = fold_sightings(sightings)
    return folded.withColumns(
        {"id": F.col("first_seq"), "updated_at": F.col("last_seen_at")}
    ).drop("first_seq", "seq")


def mark_seen(snapshot: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Count one more sighting for every id, once per time it is listed."""
    marks = ids.groupBy("id").agg(F.count(F.lit(1)).alias("marks"))
    seen = F.col("marks").isNotNull()
    return (
        snapshot.join(marks, "id", "left")
        .withColumns(
            {
                "last_seen_at": F.when(seen, _at(now)).otherwise(F.col("last_seen_at")),
                "updated_at": F.when(seen, _at(now)).otherwise(F.col("updated_at")),
                "seen_count": F.col("seen_count") + F.coalesce(F.col("marks"), F.lit(0)),
            }
        )
        .drop("marks")
    )


# --- run log --------------------------------------------------------------------------------------


def run_log_create(runs: DataFrame) -> DataFrame:
    """Pending log events from rows of (id, started_at)."""
    return runs.select(
        F.col("id").cast("bigint"),
        F.col("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(0).alias("sources_scraped"),
        F.lit(0).cast("bigint").alias("jobs_found"),
        F.lit(0).cast("bigint").alias("jobs_new"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("started_at").alias("created_at"),
    )


def run_log_finish(results: DataFrame) -> DataFrame:
    """Closing log events from rows of (id, finished_at, counts, status, error_message)."""
    empty = F.lit(None).cast("timestamp")
    return results.select(
        F.col("id").cast("bigint"),
        empty.alias("started_at"),
        "finished_at",
        F.col("sources_scraped").cast("int").alias("sources_scraped"),
        F.col("jobs_found").cast("bigint").alias("jobs_found"),
        F.col("jobs_new").cast("bigint").alias("jobs_new"),
        "status",
        "error_message",
        empty.alias("created_at"),
    )


def run_log_view(events: DataFrame) -> DataFrame:
    """Current run log: the latest closing event of every run over its opening event."""
    latest = F.struct("finished_at", "sources_scraped", "jobs_found", "jobs_new", "status", "error_message")
    return (
        events.groupBy("id")
        .agg(
            F.min("started_at").alias("started_at"),
            F.max_by(latest, F.coalesce("finished_at", F.timestamp_seconds(F.lit(0)))).alias("latest"),
            F.min("created_at").alias("created_at"),
        )
        .select("id", "started_at", "latest.*", "created_at")
    )


def run_status(per_source: DataFrame, *run: str) -> DataFrame:
    """Outcome per run from one row per source: (source_rank, source, ok, found, error).

    A run succeeds when at least one source worked.  Messages are "source: error", in the order
    of the sources; a run has as many of them as it has configured sources, which bounds the list.
    """
    message = F.when(~F.col("ok"), F.concat_ws(": ", "source", "error"))
    errors = F.array_sort(
        F.collect_list(F.when(~F.col("ok"), F.struct("source_rank", message.alias("message"))))
    )
    worked = F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0))
    summary = per_source.groupBy(*run).agg(
        worked.alias("sources_scraped"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("found"))), F.lit(0)).alias("jobs_found"),
        F.transform(errors, lambda e: e["message"]).alias("errors"),
    )
    text = F.nullif(F.array_join("errors", "; "), F.lit(""))
    failed = F.col("sources_scraped") == 0
    return summary.withColumns(
        {
            "status": F.when(failed, "failed").otherwise("success"),
            "error_message": F.when(failed, F.coalesce(text, F.lit(v.NO_SOURCE_WORKED))).otherwise(text),
        }
    )
