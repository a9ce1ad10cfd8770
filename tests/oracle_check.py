"""Compare a catalogue query with its DuckDB oracle (row count, columns, values).

Mirrors the driver's check: columns are compared by name (sorted), rows as
an order-insensitive multiset of normalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t)
    ), [cols[i] for i in order]


def compare(spark_df, con, sql: str) -> dict:
    s_rows = spark_df.collect()
    s_cols = spark_df.columns
    d = con.execute(sql)
    d_cols = [c[0] for c in d.description]
    d_rows = d.fetchall()
    s_norm, s_sorted = rows_of(s_cols, [tuple(r) for r in s_rows])
    d_norm, d_sorted = rows_of(d_cols, d_rows)
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "columns_match": s_sorted == d_sorted,
        "values_match": s_norm == d_norm,
    }
    if not out["columns_match"]:
        out["columns"] = (s_sorted, d_sorted)
    if out["columns_match"] and not out["values_match"]:
        diff = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:2]
        out["first_diff"] = diff
    return out
