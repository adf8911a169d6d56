"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return None if value is None else str(value)


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    expected = sorted((tuple(plain(row[columns.index(c)]) for c in order) for row in want.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr) == expected
