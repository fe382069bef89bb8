"""CSV, JSON lines and Markdown exports of stored jobs.

All are written by as many tasks as the frame has partitions.  Markdown numbers its sections: they are
put in order over ranges, so that the files, in the order of their names, are the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocabulary as v
from postloom.operators.ordering import number_rows
from postloom.operators.serve import project_job_dict, recent_jobs


def export_csv(jobs: DataFrame, path: str) -> str:
    row = jobs.withColumn("score", F.col("score").cast("double")).select(*v.CSV_COLUMNS)
    row.write.csv(path, header=True, escape='"', emptyValue="", nullValue="")
    return path


def export_json(jobs: DataFrame, path: str) -> str:
    iso = {
        c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        for c in ("published_at", "last_seen_at", "created_at", "updated_at")
    }
    project_job_dict(jobs).withColumns(iso).write.json(path, ignoreNullFields=False)
    return path


def markdown_sections(jobs: DataFrame, *order: Column) -> DataFrame:
    """(rank, section) per job; fixed layout."""
    order = order or (F.desc_nulls_first("created_at"), F.asc("link"))

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    score = F.coalesce(F.col("score").cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)"))
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("title")),
        F.lit(""),
        F.concat(F.lit("- Empresa: "), text("company", v.MARKDOWN_NO_COMPANY)),
        F.concat(F.lit("- Local: "), text("location", v.MARKDOWN_NO_LOCATION)),
        F.concat(F.lit("- Score: "), score.cast("string")),
        F.concat(F.lit("- Link: "), F.col("link")),
        F.lit(""),
    )
    return number_rows(jobs, "rank", *order, start=1).select("rank", section.alias("section"))


def export_markdown(jobs: DataFrame, path: str, title: str = "Daily Report", *order: Column) -> str:
    sections = markdown_sections(jobs, *order)
    head = jobs.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("rank"), F.lit(f"# {title}\n").alias("section")
    )
    page = head.unionByName(sections).repartitionByRange("rank").sortWithinPartitions("rank")
    page.select("section").write.text(path)
    return path


EXPORTERS = {"csv": export_csv, "json": export_json, "markdown": export_markdown}


def export_jobs(store: DataFrame, path: str, format: str = "csv", limit: int = 100) -> str:
    """Write the most recent jobs in one of the three formats."""
    if format not in EXPORTERS:
        raise ValueError(f"unknown export format {format!r}; use one of {sorted(EXPORTERS)}")
    return EXPORTERS[format](recent_jobs(store, limit), path)
