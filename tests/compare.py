"""Runs a named query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        raise TypeError("decimal in a compared result; cast it to double")
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def kind(v):
    return {int: "int", float: "float", str: "str", bool: "bool"}.get(type(v), type(v).__name__)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    done = con.execute(sql)
    names, types = [d[0] for d in done.description], [str(d[1]) for d in done.description]
    bad = [f"{n}:{t}" for n, t in zip(names, types) if t.startswith(("DECIMAL", "HUGEINT", "FLOAT"))]
    want = rows_of(names, done.fetchall())
    if bad:
        return f"oracle types {bad}"
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
             "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    mine = dict(spark_df.dtypes)
    wrong = [f"{n}: {mine[n]} != {t}" for n, t in zip(names, types) if kinds.get(t, t) != mine[n]]
    if wrong:
        return f"types {wrong}"
    if len(got[1]) != len(want[1]):
        extra = set(got[1]) - set(want[1])
        missing = set(want[1]) - set(got[1])
        return f"{len(got[1])} rows != {len(want[1])}; only spark {list(extra)[:2]}; only sql {list(missing)[:2]}"
    for a, b in zip(*[x[1] for x in (got, want)]):
        if a != b:
            return f"row {[(n, x, y) for n, x, y in zip(got[0], a, b) if x != y]} in {a[:6]}"
    return None
