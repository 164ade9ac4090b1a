"""Compares a query's rows with those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb


def plain(value):
    if value is None or value != value:
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        where = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{where}'")
    found = c.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == names
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
