"""A query against its DuckDB twin."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def spark_rows(df, columns) -> Counter:
    return Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
