"""Row shapes of the three stages: landed record, posting, stored job; and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# DDL text: usable as a reader schema and without a running session.
ISSUE = (
    "id BIGINT, number BIGINT, state STRING, title STRING, body STRING, html_url STRING, "
    "created_at STRING, updated_at STRING, comments INT, labels ARRAY<STRUCT<name: STRING>>, "
    "pull_request STRING"
)

POSTING: dict[str, str] = {
    "seq": "bigint",
    "title": "string",
    "company": "string",
    "location": "string",
    "stack": "array<string>",
    "link": "string",
    "source": "string",
    "external_id": "string",
    "published_at": "timestamp",
    "seniority": "string",
    "salary_min": "decimal(12,2)",
    "salary_max": "decimal(12,2)",
    "salary_currency": "string",
    "contract_type": "string",
    "remote_type": "string",
    "country": "string",
    "city": "string",
    "raw_payload": "map<string,string>",
    "description": "string",
}
POSTING_DDL = ", ".join(f"{name} {kind}" for name, kind in POSTING.items())

# What readers carry along beside the posting: its number, or where its record stood.
CARRIED = ("seq", "landed_file", "landed_row")

# Columns an upsert replaces; the stored row adds id, created_at and the sighting columns.
BUSINESS_COLUMNS = (
    "title", "company", "location", "stack", "source", "external_id", "fingerprint",
    "content_hash", "published_at", "seniority", "score", "score_reasons", "raw_payload",
    "salary_min", "salary_max", "salary_currency", "contract_type", "remote_type", "country",
    "city", "status",
)

RUN_LOG = (
    "id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, sources_scraped INT, "
    "jobs_found BIGINT, jobs_new BIGINT, status STRING, error_message STRING, created_at TIMESTAMP"
)

# Shortest and longest value of each text column.
TEXT_LIMITS: dict[str, tuple[int, int]] = {
    "title": (2, 300),
    "company": (0, 200),
    "location": (0, 200),
    "link": (8, 500),
    "source": (2, 100),
    "external_id": (0, 200),
    "seniority": (0, 50),
    "salary_currency": (0, 10),
    "contract_type": (0, 50),
    "remote_type": (0, 50),
    "country": (0, 100),
    "city": (0, 120),
}
REQUIRED_TEXTS = ("title", "link", "source")


def with_posting_columns(df: DataFrame) -> DataFrame:
    """Add the posting columns a reader did not deliver, as typed NULLs."""
    missing = {n: F.lit(None).cast(t) for n, t in POSTING.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def as_postings(df: DataFrame) -> DataFrame:
    """The posting columns, in order and with their types, and where the record stood, if known."""
    df = with_posting_columns(df)
    place = [c for c in ("landed_file", "landed_row") if c in df.columns]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in POSTING.items()], *place)
