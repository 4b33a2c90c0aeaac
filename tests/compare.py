"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp": "TIMESTAMP"}


def connection(folder: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    result = con.sql(sql)
    assert names == sorted(result.columns)
    kinds = dict(zip(result.columns, map(str, result.types), strict=True))
    assert {n: KINDS[k] for n, k in df.dtypes} == kinds
    place = [result.columns.index(n) for n in names]
    want = sorted(repr(tuple(_plain(row[i]) for i in place)) for row in result.fetchall())
    table = df.select(*names).toArrow()
    got = sorted(repr(tuple(map(_plain, row))) for row in zip(*(c.to_pylist() for c in table.columns), strict=True))
    assert len(got) == len(want)
    assert got == want
