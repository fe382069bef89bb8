"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, float):
        return f"{value:.6f}"
    return f"{type(value).__name__[:3] if isinstance(value, bool) else ''}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in rows])


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    return rows_of([c[0] for c in cursor.description], cursor.fetchall())


def difference(got, want, show: int = 3) -> str:
    """'' when equal, else what differs first."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return ""
    extra = sorted(set(got[1]) - set(want[1]))[:show]
    missing = sorted(set(want[1]) - set(got[1]))[:show]
    return f"rows {len(got[1])} != {len(want[1])}; only here {extra}; only there {missing}"
