"""Compare registered queries with their SQL counterparts run by DuckDB.

As a script: ``python tests/compare.py [sf_dir] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def plain(value):
    """A form in which equal values of both engines are equal."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (int(value) if value == int(value) else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def difference(got, wanted) -> str | None:
    if got[0] != wanted[0]:
        return f"columns {got[0]} != {wanted[0]}"
    if len(got[1]) != len(wanted[1]):
        return f"rows {len(got[1])} != {len(wanted[1])}"
    differing = [(a, b) for a, b in zip(got[1], wanted[1]) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main(argv):
    from tablewright import build_session
    from tablewright.suite import ORACLES, QUERIES

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for key in keys:
        started = time.time()
        try:
            got = spark_rows(QUERIES[key](spark, sf))
            took = time.time() - started
            problem = difference(got, oracle_rows(con, ORACLES[key])) if key in ORACLES else None
            note = problem or ("ok" if key in ORACLES else f"rows only ({len(got[1])})")
        except Exception as error:
            took, problem = time.time() - started, f"{type(error).__name__}: {str(error)[:600]}"
            note = problem
        if problem:
            bad.append(key)
        print(f"{key:34s} {took:7.2f}s  {note}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} pass; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
