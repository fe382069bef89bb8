"""The daily run over a stream of landed postings.

Every micro-batch is numbered, deduplicated, scored and appended as sightings to its own folder
``sightings/batch=<id>``, its keys to ``keys/run=<run>/batch=<id>``.  A retried batch overwrites exactly these
folders, so it is applied once.  Nothing stored earlier is rewritten, which is what makes small batches
cheap on a large store.

How many files a micro-batch takes has no influence on the result: rows are numbered by (file,
position), files are taken in the order of their landing, and what earlier micro-batches of the same
``run`` have kept counts as kept before.  A run is by default a day: a link that comes again in
another run is one more sighting of it.  Only the narrow keys of the run are read for that, so that a
micro-batch reads no more files the longer the history is.

The current table is the fold of all sightings.  :func:`compact` writes it down as a base and publishes it by
a pointer; from then on only the base and later batches are folded.
"""

from __future__ import annotations

import datetime as dt
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.keys import with_keys
from postloom.operators.dedupe import KEYS, dedupe_batch, drop_stored
from postloom.operators.ordering import in_ranges, numbered
from postloom.operators.postings import with_errors
from postloom.operators.scoring import build_payloads
from postloom.operators.store import fold_sightings
from postloom.profile import MatchProfile
from postloom.session import children, materialize

# Numbers within a batch stay below this, so that (batch, number) is one growing number.
PER_BATCH = 1 << 40


def read_landed(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream of parquet files with posting columns, and where each row stood."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumns(
        {"landed_file": F.col("_metadata.file_path"), "landed_row": F.col("_metadata.row_index")}
    )


def _keys_folder(store: str, run: str) -> str:
    return f"{store}/keys/run={quote(run, safe='')}"


def _kept_before(spark: SparkSession, store: str, batch_id: int, run: str) -> DataFrame | None:
    """Keys kept by the run's earlier batches; not by this one, which a retry would meet."""
    folder = _keys_folder(store, run)
    earlier = [b for b in _batches(spark, folder) if b < batch_id]
    return spark.read.parquet(*[f"{folder}/batch={b}" for b in earlier]) if earlier else None


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[6:]) for n in children(spark, folder) if n.startswith("batch="))


def apply_batch(
    batch: DataFrame, batch_id: int, store: str, now, profile: MatchProfile | None = None,
    run: str = "",
) -> None:
    """Process one micro-batch and write it as the sightings of this batch, exactly once."""
    place = [c for c in ("landed_file", "landed_row") if c in batch.columns]
    order = place or [c for c in ("link", "title") if c in batch.columns]
    sorted_rows = in_ranges(batch.drop("seq"), *[F.asc_nulls_first(c) for c in order])
    checked = materialize(with_errors(sorted_rows), "checked", "valid")
    accepted = numbered(checked.filter("valid").drop("valid", "errors", *place), "seq", counted=checked)
    before = _kept_before(batch.sparkSession, store, batch_id, run)
    if before is not None:  # before duplicates of the batch, as rows that go here block no others
        accepted = drop_stored(materialize(with_keys(accepted), "keyed"), before)
    scored = build_payloads(dedupe_batch(accepted), profile or MatchProfile())
    seen_at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    sightings = scored.withColumns({"seen_at": seen_at, "run": F.lit(run)})
    sightings.write.mode("overwrite").parquet(f"{store}/sightings/batch={batch_id}")
    written = batch.sparkSession.read.schema(sightings.schema).parquet(f"{store}/sightings/batch={batch_id}")
    written.select(*KEYS).write.mode("overwrite").parquet(f"{_keys_folder(store, run)}/batch={batch_id}")
    rejects = numbered(checked.filter("not valid"), "seq", counted=checked)
    rejects.select("seq", "source", "link", "errors", *place).write.mode("overwrite").parquet(
        f"{store}/rejects/batch={batch_id}"
    )


def incremental_ingest(
    landed: DataFrame, store: str, checkpoint: str, now=None, profile: MatchProfile | None = None,
    run: str | None = None,
):
    """Run the stream over everything that is there and stop; returns the finished query."""
    run = run or str((now or dt.datetime.now(dt.timezone.utc)).date())

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, store, now, profile, run)

    query = (
        landed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def sightings(spark: SparkSession, store: str) -> DataFrame:
    """All sightings ever written."""
    return spark.read.parquet(f"{store}/sightings")


def _base(spark: SparkSession, store: str) -> tuple[int, str | None]:
    """(last batch in the base, its folder); (-1, None) without a base."""
    if not children(spark, f"{store}/bases"):
        return -1, None
    pointers = spark.read.schema("folder string, upto long").parquet(f"{store}/bases")
    row = pointers.agg(F.max(F.struct("upto", "folder")).alias("last")).first()["last"]
    return (row["upto"], row["folder"]) if row else (-1, None)


def _folded(spark: SparkSession, store: str, batches: list[int]) -> DataFrame:
    """One row per link of these batches: latest values, first and last sighting, number of sightings.

    A batch holds a link once, so (batch, number) orders the sightings of a link and its first such number
    is an id that no other link has.
    """
    rows = spark.read.option("basePath", f"{store}/sightings").parquet(
        *[f"{store}/sightings/batch={b}" for b in batches]
    )
    rows = rows.withColumn("order", F.col("batch").cast("bigint") * PER_BATCH + F.col("seq"))
    folded = fold_sightings(rows.drop("seq", "batch", "run"), order="order")
    return folded.withColumn("id", F.col("first_seq")).drop("first_seq")


def _state(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame | None:
    """The fold of all sightings, or of those of batches up to ``upto``: the base and what came after it."""
    last, folder = _base(spark, store)
    later = [b for b in _batches(spark, f"{store}/sightings") if b > last and (upto is None or b <= upto)]
    base = spark.read.parquet(folder) if folder else None
    if not later:
        return base
    fresh = _folded(spark, store, later)
    if base is None:
        return fresh
    names = [c for c in base.columns if c != "link"]
    both = base.select("link", F.struct(*names).alias("old")).join(
        fresh.select("link", F.struct(*names).alias("new")), "link", "full_outer"
    )
    newest = F.coalesce(
        F.struct("new.last_seen_at", "new.order") > F.struct("old.last_seen_at", "old.order"), F.col("old").isNull()
    )
    latest = F.when(newest, F.col("new")).otherwise(F.col("old"))
    values = {c: latest[c] for c in names}
    values["created_at"] = F.least("old.created_at", "new.created_at")
    values["id"] = F.least("old.id", "new.id")
    values["seen_count"] = F.coalesce("old.seen_count", F.lit(0)) + F.coalesce("new.seen_count", F.lit(0))
    return both.select("link", *[value.alias(name) for name, value in values.items()])


def compact(spark: SparkSession, store: str, upto: int | None = None) -> int:
    """Fold the sightings up to batch ``upto`` into a new base; returns the last batch in the base.

    By default the newest batch is left out, as a failed stream may still write it again.  The base is
    written to a folder of its own and published by a pointer, so whoever reads meanwhile sees the old one.
    """
    last, _ = _base(spark, store)
    batches = _batches(spark, f"{store}/sightings")
    upto = max([last, *batches[:-1]]) if upto is None else upto
    if upto <= last:
        return last
    folder = f"{store}/base/upto={upto}-{uuid.uuid4().hex}"
    _state(spark, store, upto).write.mode("errorifexists").parquet(folder)
    published = spark.createDataFrame([(folder, upto)], "folder string, upto long")
    published.coalesce(1).write.mode("append").parquet(f"{store}/bases")
    return upto


def current(spark: SparkSession, store: str) -> DataFrame:
    """The store: one row per link, latest values, first and last sighting, number of sightings.

    It has the columns of a stored snapshot; ``id`` is made of the batch and the number of the first sighting.
    """
    state = _state(spark, store)
    if state is None:
        raise FileNotFoundError(f"no sightings in {store}")
    return state.withColumn("updated_at", F.col("last_seen_at")).drop("order")
