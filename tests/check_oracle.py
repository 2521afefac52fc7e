"""Compare every registered query with its SQL in DuckDB.

    python tests/check_oracle.py [folder] [query ...]
"""

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as registered  # noqa: E402
from opinara.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def canonical(frame):
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].itertuples(index=False):
        rows.append(
            tuple(
                "null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
                for v in row
            )
        )
    return columns, sorted(rows)


def compare(spark, connection, folder, name):
    """None when equal, otherwise what differs; queries without SQL only have to run."""
    got = registered.queries()[name](spark, folder)
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return None if got.count() else "no rows"
    left, right = canonical(got.toPandas()), canonical(connection.execute(sql).df())
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} and {len(right[1])} rows"
    different = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    work = tempfile.mkdtemp(prefix="opinara-check-")
    spark = build_session(
        "check", "8", **{"spark.checkpoint.dir": f"{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse"}
    )
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in registered.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} right")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
