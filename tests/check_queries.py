"""Run registered queries next to their check SQL in DuckDB.

    python tests/check_queries.py [sf] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    """None if equal, else what differs."""
    started = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "cross join in the plan", len(got), spent
    if sql is None:
        return None if got else "no rows", len(got), spent
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), spent
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got), spent
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}", len(got), spent
    return (None if got else "no rows"), len(got), spent


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(f"/root/testdata/sf{sf}")
    bad = 0
    for query in names:
        try:
            wrong, count, spent = compare(
                session, con, query, entry.queries()[query], entry.oracle_sql().get(query), f"/root/testdata/sf{sf}"
            )
        except Exception as error:  # noqa: BLE001  (report and go on)
            wrong, count, spent = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        bad += wrong is not None
        print(f"{'ok ' if wrong is None else 'BAD'} {query} rows={count} {spent:.1f}s {wrong or ''}", flush=True)
    print("bad:", bad)
