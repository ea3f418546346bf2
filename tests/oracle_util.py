"""Compare a Spark DataFrame with a DuckDB query, order-insensitively.

Mirrors the driver's gate: same row count, same column names, same multiset
of rows (columns sorted by name, floats rounded, timestamps as text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from berth.sources.fixtures import BASE_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", str(x)) for x in row)


def rows_spark(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, sorted(out, key=_key)


def rows_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(out, key=_key)


def _num_eq(a, b):
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(float(a) - float(b)) <= 1e-6 * max(1.0, abs(float(a)))
    return False


def compare(df, con, sql):
    """Return (ok, message)."""
    sc, sr = rows_spark(df)
    dc, dr = rows_duck(con, sql)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row counts differ: spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if len(a) != len(b) or not all(_num_eq(x, y) for x, y in zip(a, b)):
            return False, f"first differing row:\n spark={a}\n duck ={b}"
    return True, f"{len(sr)} rows equal"
