"""Compare a query with its SQL over the same tables, whatever the order of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of_sql(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf: str) -> str:
    """'' if equal."""
    a, b = canonical(df.columns, df.collect()), canonical(*rows_of_sql(sql, sf))
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        x, y = set(a[1]), set(b[1])
        return f"{len(a[1])} and {len(b[1])} rows; only here {sorted(x - y)[:3]}, only there {sorted(y - x)[:3]}"
    return ""
