"""Issue records: JSON lines, arrays, and objects written over several lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.functions.features import company_from_issue, location_from_issue
from postloom.operators.postings import build_postings, safe_datetime
from postloom.schema import CARRIED, ISSUE


def parse_issues(lines: DataFrame, column: str = "value") -> DataFrame:
    """Issue columns plus ``is_pull_request`` (the key is there, whatever its value), ``corrupt`` for
    records that are no JSON object, and their text in ``corrupt_text``."""
    keys = F.json_object_keys(column)
    record = F.from_json(column, ISSUE)
    rest = [c for c in lines.columns if c != column]
    return lines.withColumns({"__r": record, "__k": keys}).select(
        *rest,
        "__r.*",
        F.coalesce(F.array_contains("__k", "pull_request"), F.lit(False)).alias("is_pull_request"),
        F.col("__k").isNull().alias("corrupt"),
        F.when(F.col("__k").isNull(), F.col(column)).alias("corrupt_text"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(landed_file, landed_row, value): one JSON record each, in the order of the files.

    A file that begins with ``[``, or with a line that is ``{`` alone, is one document (an array
    or an object over several lines) and is read whole; all others hold a record per line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("landed_file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.monotonically_increasing_id().alias("at"),
    )
    filled = lines.filter(F.trim("value") != "")
    heads = filled.filter("start = 0").groupBy("landed_file").agg(
        F.min_by(F.trim("value"), "at").alias("head")
    )
    whole = heads.filter(F.col("head").startswith("[") | (F.col("head") == "{")).select("landed_file")
    files = [row[0] for row in whole.collect()]  # a list of files, as any reader keeps one
    by_line = filled.filter(~F.col("landed_file").isin(files)) if files else filled
    # Rows of a file: by their block, then by their place in it.
    row = F.row_number().over(Window.partitionBy("landed_file", "start").orderBy("at"))
    by_line = by_line.select("landed_file", (F.col("start") + row).alias("landed_row"), "value")
    if not files:
        return by_line
    documents = spark.read.text(files, wholetext=True).select(
        F.col("_metadata.file_path").alias("landed_file"), "value"
    )
    items = F.from_json("value", "array<string>")
    broken = F.array(F.col("value"))  # what is no array is one record, broken or not
    each = F.when(F.trim("value").startswith("["), F.coalesce(items, broken)).otherwise(broken)
    in_documents = documents.select("landed_file", F.posexplode(each).alias("landed_row", "value"))
    return by_line.unionByName(in_documents.withColumn("landed_row", F.col("landed_row").cast("bigint")))


def drop_pull_requests(issues: DataFrame) -> DataFrame:
    return issues.filter(~F.col("is_pull_request"))


def open_since(issues: DataFrame, as_of, days: int = 14, keep_corrupt: bool = False) -> DataFrame:
    """Open issues touched in the last ``days`` days before ``as_of``."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    wanted = (F.col("state") == "open") & (safe_datetime(F.col("updated_at")) >= since)
    return issues.filter(wanted | F.col("corrupt") if keep_corrupt else wanted)


def issue_postings(issues: DataFrame, source: str = "issues") -> DataFrame:
    labels = F.array_join(F.transform("labels", lambda x: F.coalesce(x["name"], F.lit(""))), " ")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(v.REPORT_NO_TITLE))
    body = F.coalesce(F.col("body"), F.lit(""))
    number = F.coalesce(F.nullif("number", F.lit(0)), F.nullif("id", F.lit(0)))
    if "corrupt_text" in issues.columns:  # a broken record keeps its text for repair
        body = F.coalesce("body", "corrupt_text", F.lit(""))
    payload = F.create_map(
        F.lit("issue_number"), F.col("number").cast("string"),
        F.lit("id"), F.col("id").cast("string"),
        F.lit("labels"), F.to_json("labels"),
        F.lit("state"), F.col("state"),
        F.lit("comments"), F.col("comments").cast("string"),
        F.lit("updated_at"), F.col("updated_at"),
    )
    rest = [c for c in CARRIED if c in issues.columns]
    found = issues.withColumn("extra_text", F.coalesce(labels, F.lit(""))).select(
        *rest,
        title.alias("title"),
        body.alias("description"),
        "extra_text",
        company_from_issue(title, body).alias("company"),
        location_from_issue(title, body, F.col("extra_text")).alias("location"),
        F.col("html_url").alias("link"),
        F.coalesce(number.cast("string"), F.lit("")).alias("external_id"),
        safe_datetime(F.col("created_at")).alias("published_at"),
        F.lit(source).alias("source"),
        payload.alias("raw_payload"),
    )
    return build_postings(found)


def read_issues(
    spark: SparkSession, path: str, source: str = "issues", as_of=None, days: int = 14
) -> DataFrame:
    """Postings of the issue files under ``path``; pull requests are left out.

    With ``as_of`` only open issues touched in the ``days`` before it are taken (and broken
    records, which become rejects with their text).  ``seq`` is not set here; ``landed_file``
    and ``landed_row`` say where a record stood (see ``daily_run.numbered``).
    """
    issues = drop_pull_requests(parse_issues(read_records(spark, path)))
    if as_of is not None:
        issues = open_since(issues, as_of, days, keep_corrupt=True)
    return issue_postings(issues, source)
