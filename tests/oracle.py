"""Spark-vs-DuckDB comparison, as the driver's correctness gate does it:
row count, column names, and an order-insensitive hash of the values with
columns sorted by name."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


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
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str, list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    normed = sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else x for x in t)
    )
    h = hashlib.sha256(repr(normed).encode()).hexdigest()
    return len(rows), names, h, normed


def compare(spark, sf_dir: str, name: str, query, sql: str) -> dict:
    sdf = query(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s = digest(sdf.columns, s_rows)
    con = duck(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d = digest(d_cols, [tuple(r) for r in res.fetchall()])
    out = {
        "name": name,
        "rows": (s[0], d[0]),
        "columns_match": s[1] == d[1],
        "hash_match": s[2] == d[2],
    }
    if not out["hash_match"]:
        diff_s = [r for r in s[3] if r not in set(d[3])][:3]
        diff_d = [r for r in d[3] if r not in set(s[3])][:3]
        out["spark_only"] = diff_s
        out["duck_only"] = diff_d
        out["columns"] = (s[1], d[1])
    return out
