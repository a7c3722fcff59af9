"""Run a registered query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

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
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names: list[str], records) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(names)), key=names.__getitem__)
    cells = [tuple(plain(r[i]) for i in at) for r in records]
    return [names[i] for i in at], sorted(cells, key=repr)


def compare(spark, query, sql: str | None, folder: str, con=None):
    """``(problem or None, number of rows, seconds in Spark, seconds in SQL)``."""
    began = time.time()
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - began
    if sql is None:
        return None, len(got[1]), spark_seconds, 0.0
    began = time.time()
    con = con or connect(folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    sql_seconds = time.time() - began
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"rows {len(got[1])} != {len(want[1])}"
    elif got[1] != want[1]:
        differ = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        problem = f"{len(differ)} rows differ, first {differ[0]}"
    return problem, len(got[1]), spark_seconds, sql_seconds
