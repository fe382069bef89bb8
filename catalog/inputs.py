"""Inputs shared by the queries, all derived from the whole driver tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog.bridge import raw_postings, table
from postloom.functions.keys import with_keys
from postloom.operators.postings import build_postings
from postloom.operators.scoring import build_payloads
from postloom.operators.store import snapshot_of
from postloom.schema import as_postings
from postloom.session import new_folder


# Rows that a task of text work gets.
TASK_ROWS = 1_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly over the cores, and over more tasks the more there are.

    Text work is CPU-bound and the splits of files are not even: a row group is read by one task, however
    many splits its bytes make, so a table in one file may be the work of one task.  Rows are counted from the
    footers of the files.
    """
    return df.repartition(_tasks(df))


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(raw_postings(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(raw(spark, sf_dir))


def landed_postings(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Postings in ranges of ``seq``, sorted in each, with ``part``: as many runs of these ranges as there are parts.

    There are more ranges the more rows there are, so that no task gets a whole part of a large table.
    """
    rows = raw_postings(spark, sf_dir)
    each = -(-_tasks(rows) // parts)
    ranges = rows.repartitionByRange(parts * each, "seq").sortWithinPartitions("seq")
    return as_postings(build_postings(ranges)).withColumn("part", F.floor(F.spark_partition_id() / each).cast("int"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_payloads(postings(spark, sf_dir))


_tables: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once per application and folder and read from then on."""
    make = {"payloads": payloads, "store": _store, "old_store": _old_store, "keyed": _keyed}[name]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _tables:
        path, schema = _tables[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was cleaned up
            del _tables[key]
    path = new_folder(spark, name)
    table = make(spark, sf_dir)
    table.write.parquet(path)
    _tables[key] = (path, table.schema)
    return spark.read.schema(table.schema).parquet(path)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_keys(postings(spark, sf_dir)).select(
        "seq", "link", "fingerprint", "content_hash", "published_at"
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their keys, as a table."""
    return _written(spark, sf_dir, "keyed")


def payload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored payloads of all postings, as a table."""
    return _written(spark, sf_dir, "payloads")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_of(payload_table(spark, sf_dir).withColumn("seen_at", F.col("published_at")))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored jobs: all sightings of a link folded into one row, as a table."""
    return _written(spark, sf_dir, "store")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq")).distinct()


def _old_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = payload_table(spark, sf_dir).join(labelled(spark, sf_dir), "seq", "left_semi")
    return snapshot_of(old.withColumn("seen_at", F.col("published_at")))


def old_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before: the postings whose document has a label."""
    return _written(spark, sf_dir, "old_store")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives: the other postings, the latest of every link."""
    new = payload_table(spark, sf_dir).join(labelled(spark, sf_dir), "seq", "left_anti")
    latest = new.groupBy("link").agg(F.max("seq").alias("seq")).select("seq")
    return new.join(latest, "seq", "left_semi").withColumn("id", F.col("seq"))


def pipe(items: Column) -> Column:
    return F.array_join(items, "|")


def stamp(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def dbl(name: str) -> Column:
    return F.col(name).cast("double").alias(name)
