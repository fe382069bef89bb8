"""Stored snapshots and run logs as parquet tables.

A store keeps its rows in buckets of their link, and beside them an index from every key of a row (id,
fingerprint, content hash) to its link, in buckets of the key.  A run writes new files for the buckets its
batch touches and then, as its last step, a pointer that names the folder of every bucket; a store is
read through its latest pointer.  Folders are never changed: every run writes to one of its own, and
a version that exists is stepped over.  So a run that fails leaves the store as it was, and what
other buckets hold is neither read nor written.  The pointer also records how rows are dealt into
buckets; buckets that grow split (see ``buckets``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postloom.operators.dedupe import KEYS, SMALL_BATCH_ROWS, dedupe_batch
from postloom.operators.store import check_unique, merge_rows, run_log_view
from postloom.session import children, written
from postloom.sources.buckets import (
    Slot,
    chosen,
    first_slots,
    placed,
    read_slots,
    rows_by_slot,
    split,
    write_slots,
)

# Buckets of a new store, and rows a bucket of it holds before it splits.
BUCKETS = 64
BUCKET_ROWS = 500_000
# Index entries are a hundred times as narrow.
ENTRY_ROWS = 5_000_000
INDEXED = ("id", "fingerprint", "content_hash")
POINTER = "part string, modulus int, bucket int, folder string, rows long"
ENTRY = "kind string, key string, link string, id long, created_at timestamp"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_store(snapshot: DataFrame, path: str) -> None:
    """Write a snapshot to a NEW folder; the folder it was read from stays as it is.

    Rows are sorted by score inside each file, so that reads of the best scores skip row groups by
    their statistics.
    """
    snapshot.sortWithinPartitions(F.desc("score")).write.mode("errorifexists").parquet(path)


def _free_version(spark: SparkSession, path: str, version: int) -> int:
    """The first version from ``version`` on that is above all pointers, also unfinished ones."""
    names = children(spark, f"{path}/pointers")
    return max([version, *(int(n[2:]) + 1 for n in names if n.startswith("v=") and n[2:].isdigit())])


def directories(spark: SparkSession, path: str) -> dict[str, list[Slot]]:
    """Slots of the rows ("data") and of their index ("keys") in the latest version; empty without any."""
    if not children(spark, f"{path}/pointers"):
        return {}
    pointers = spark.read.schema(f"{POINTER}, v int").parquet(f"{path}/pointers")
    latest = pointers.filter(F.col("v") == F.lit(pointers.agg(F.max("v")).first()[0]))
    found: dict[str, list[Slot]] = {}
    for r in latest.collect():  # one row per bucket
        found.setdefault(r["part"], []).append(Slot(r["modulus"], r["bucket"], r["folder"], r["rows"]))
    return found


def pointer(spark: SparkSession, path: str) -> dict[tuple[int, int], str]:
    """Folder of each bucket that has rows, by (modulus, bucket), in the latest version."""
    return {s.place: s.folder for s in directories(spark, path).get("data", []) if s.folder}


def current_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the latest version; None for a store without any."""
    return read_slots(spark, directories(spark, path).get("data", []))


def by_link(link: str = "link") -> Column:
    return F.xxhash64(link)


def by_key() -> Column:
    return F.xxhash64("kind", "key")


def entries(rows: DataFrame) -> DataFrame:
    """Index entries of stored rows: one for each key that is neither NULL nor empty."""
    keys = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in INDEXED if k in rows.columns]
    )
    each = rows.select(F.explode(keys).alias("entry"), "link", "id", "created_at")
    return each.select("entry.*", "link", F.col("id").cast("long").alias("id"), "created_at").where(F.length("key") > 0)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_BATCH_ROWS else df


def upsert_store(
    spark: SparkSession, path: str, batch: DataFrame, empty: DataFrame, now, version: int,
    buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS,
) -> dict[str, int]:
    """Merge a batch, of unique links, into the store as a new version; returns what it changed.

    The version is ``version``, or the next above all that exist.  ``empty`` gives the columns of a store
    that has no version yet, ``buckets`` the number it begins with; a bucket that would hold more than
    ``bucket_rows`` rows splits.
    """
    check_unique(batch)
    known = directories(spark, path)
    slots = known.get("data") or first_slots(buckets)
    arriving = rows_by_slot(placed(batch.select("link"), slots, by_link()))
    touched = chosen(slots, arriving)
    stored = read_slots(spark, touched)
    merged = merge_rows(empty if stored is None else stored, batch, now, "__was", "__is")
    # What the batch changed is counted as the rows are written.
    seen = Observation()
    counted = merged.observe(
        seen, F.count_if("__is").alias("affected"), F.count_if(F.col("__is") & ~F.col("__was")).alias("inserted")
    ).drop("__was", "__is")
    version = _free_version(spark, path, version)
    folder = f"{path}/data/v={version}-{uuid.uuid4().hex}"
    fresh = write_slots(counted, split(touched, arriving, bucket_rows), by_link(), folder, F.desc("score"))
    counts = seen.get if touched else {"affected": 0, "inserted": 0}
    links = _small(batch.select("link"), sum(arriving.values()))
    index = _updated_index(
        spark, path, known.get("keys") or first_slots(buckets), version, links, stored, read_slots(spark, fresh)
    )
    parts = {"data": [s for s in slots if s not in touched] + fresh, "keys": index}
    rows = [(part, *s.place, s.folder, s.rows) for part, some in parts.items() for s in some]
    table = spark.createDataFrame(sorted(rows, key=str), POINTER)
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/pointers/v={version}")
    return {**counts, "updated": counts["affected"] - counts["inserted"]}


def _updated_index(
    spark: SparkSession, path: str, slots: list[Slot], version: int, links: DataFrame,
    before: DataFrame | None, after: DataFrame | None,
) -> list[Slot]:
    """Index slots after rows with these links have changed; only the slots of their keys are rewritten."""
    if after is None:
        return slots
    new, _ = written(entries(after.join(links, "link", "left_semi")), "entries")
    gone = None if before is None else entries(before.join(links, "link", "left_semi"))
    changed = new if gone is None else new.unionByName(gone)
    touched = chosen(slots, rows_by_slot(placed(changed.select("kind", "key"), slots, by_key())))
    arriving = rows_by_slot(placed(new.select("kind", "key"), slots, by_key()))
    old = read_slots(spark, touched)
    if old is not None:
        new = old.join(links, "link", "left_anti").unionByName(new)
    folder = f"{path}/keys/v={version}-{uuid.uuid4().hex}"
    fresh = write_slots(new, split(touched, arriving, ENTRY_ROWS), by_key(), folder, "kind", "key")
    return [s for s in slots if s not in touched] + fresh


# --- lookups that read only the buckets of what is looked for ---------------------------------------


def entries_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Index entries of the keys (kind, key): reads the buckets these fall into and no others.

    ``wanted`` holds distinct keys, without NULLs.
    """
    slots = directories(spark, path).get("keys", [])
    wanted, rows = written(wanted.select("kind", "key"), "wanted")
    read = read_slots(spark, chosen(slots, rows_by_slot(placed(wanted, slots, by_key())))) if slots else None
    if read is None:
        return spark.createDataFrame([], ENTRY)
    return read.join(_small(wanted, rows), ["kind", "key"], "left_semi")


def rows_of(spark: SparkSession, path: str, links: DataFrame, columns: list[str] | None = None) -> DataFrame | None:
    """Stored rows with these distinct links, from the buckets of the links; None if those hold nothing."""
    slots = directories(spark, path).get("data", [])
    links, rows = written(links.select("link"), "links")
    read = read_slots(spark, chosen(slots, rows_by_slot(placed(links, slots, by_link())))) if slots else None
    if read is None:
        return None
    return (read.select(*columns) if columns else read).join(_small(links, rows), "link", "left_semi")


def job_by_id(spark: SparkSession, path: str, job: int) -> DataFrame | None:
    """The stored row with this id, read from one bucket of the index and one of the rows."""
    key = spark.range(1).select(F.lit("id").alias("kind"), F.lit(str(job)).alias("key"))
    return rows_of(spark, path, entries_of(spark, path, key).select("link").distinct())


def existing_keys(
    spark: SparkSession, path: str, keys: DataFrame, key: str, as_of=None, window_days: int | None = None
) -> DataFrame:
    """``dedupe.existing_keys`` on a versioned store, through its index."""
    wanted = keys.select(key).filter(F.length(key) > 0).distinct()
    if key == "link":
        found = rows_of(spark, path, wanted, ["link", "created_at"])
        if found is None:
            return wanted.limit(0)
    else:
        kind = wanted.select(F.lit(key).alias("kind"), F.col(key).alias("key"))
        found = entries_of(spark, path, kind).withColumnRenamed("key", key)
    if window_days is not None:
        since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
        found = found.filter(F.col("created_at") >= since)
    return found.select(key).distinct()


def filter_new(spark: SparkSession, path: str, postings: DataFrame) -> DataFrame:
    """``dedupe.filter_new`` on a versioned store: only the buckets of the batch's keys are read."""
    fresh = dedupe_batch(postings)
    keys, _ = written(fresh.select("seq", *KEYS), "batch-keys")
    for key in KEYS:
        fresh = fresh.join(existing_keys(spark, path, keys, key), key, "left_anti")
    return fresh


def log_events(path: str, events: DataFrame) -> None:
    events.coalesce(1).write.mode("append").parquet(f"{path}/log")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log of a store: one row per run."""
    return run_log_view(spark.read.parquet(f"{path}/log"))
