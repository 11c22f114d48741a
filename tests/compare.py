"""Compare a Spark result with its DuckDB oracle: row count, column names
and an order-insensitive multiset of normalised rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return cols, cur.fetchall()


def multiset(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> dict:
    s_cols, s_rows = spark_rows(df)
    o_cols, o_rows = oracle_rows(con, sql)
    out = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "columns_match": sorted(s_cols) == sorted(o_cols)}
    if not out["columns_match"]:
        out["spark_only"] = sorted(set(s_cols) - set(o_cols))
        out["oracle_only"] = sorted(set(o_cols) - set(s_cols))
        out["match"] = False
        return out
    a, b = multiset(s_cols, s_rows), multiset(o_cols, o_rows)
    out["match"] = a == b
    if not out["match"]:
        out["spark_extra"] = list((a - b).items())[:3]
        out["oracle_extra"] = list((b - a).items())[:3]
        out["sorted_cols"] = sorted(s_cols)
    return out
