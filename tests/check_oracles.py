"""Run registered queries next to their SQL: ``python tests/check_oracles.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from shelfscope.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return repr(value)
    return None if value is None else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[str, float, float]:
    started = time.time()
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})", spent, 0.0
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    sql_spent = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", spent, sql_spent
    if got == want:
        return f"ok ({len(got)})", spent, sql_spent
    only_got = sorted(set(got) - set(want), key=repr)[:2]
    only_want = sorted(set(want) - set(got), key=repr)[:2]
    return f"DIFFERS {len(got)} vs {len(want)}: {only_got} / {only_want}", spent, sql_spent


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            verdict, spent, sql_spent = compare(spark, con, folder, name)
        except Exception as problem:  # report and go on with the next query
            verdict, spent, sql_spent = f"FAILED {type(problem).__name__}: {str(problem)[:600]}", 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {spent:6.2f}s {sql_spent:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
