"""Compare registered queries with their SQL twins in DuckDB.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return "<null>"
    if isinstance(value, float):
        if math.isnan(value):
            return "<nan>"
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, folder) -> str:
    df = plan(spark, folder)
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only ({len(spark_rows)} rows)"
    result = con.execute(sql)
    sql_columns, sql_rows = rows_of([c[0] for c in result.description], result.fetchall())
    if spark_columns != sql_columns:
        return f"COLUMNS {spark_columns} != {sql_columns}"
    if len(spark_rows) != len(sql_rows):
        return f"ROWS {len(spark_rows)} != {len(sql_rows)}; {spark_rows[:2]} {sql_rows[:2]}"
    different = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if different:
        return f"VALUES differ in {len(different)} of {len(spark_rows)}: {different[0]}"
    return f"ok ({len(spark_rows)} rows)"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lanternfish.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, twins = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in queries.items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, plan, twins.get(name), folder)
        except Exception as error:  # report and go on with the next query
            verdict = "ERROR " + str(error)[:1500]
        if not verdict.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{name:32s} {time.time() - start:6.1f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
