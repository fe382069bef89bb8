"""Command line: check registered queries against their SQL and print times.

    python -m tests.run_checks [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from postloom.session import local_session  # noqa: E402
from tests.compare import connect, difference, duck_rows, spark_rows  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            got = spark_rows(queries()[name](spark, folder))
        except Exception as problem:  # noqa: BLE001
            print(f"{name:28s} FAILED {str(problem)[:600]}", flush=True)
            bad += 1
            continue
        middle = time.time()
        sql = oracle_sql().get(name)
        if sql is None:
            print(f"{name:28s} rows {len(got[1])} {middle - started:.1f}s", flush=True)
            continue
        try:
            told = difference(got, duck_rows(con, sql))
        except Exception as problem:  # noqa: BLE001
            told = f"SQL: {str(problem)[:600]}"
        bad += bool(told)
        times = f"{middle - started:.1f}s/{time.time() - middle:.1f}s"
        print(f"{name:28s} {'DIFF ' + told if told else 'ok'} rows {len(got[1])} {times}", flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
