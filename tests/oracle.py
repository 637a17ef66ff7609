"""Comparison of a query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(value(r[i]) for i in order) for r in rows)


def differs(spark, directory: str, query, sql: str) -> str | None:
    """What differs between the two results, or None."""
    df = query(spark, directory)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only here {list((got[1] - want[1]).items())[:3]}, only there {list((want[1] - got[1]).items())[:3]}"
    return None
