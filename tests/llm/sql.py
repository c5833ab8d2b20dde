"""Comparison of a query with its SQL on the driver tables."""

from __future__ import annotations

import duckdb


def same_rows(df, sql: str, sf_dir: str, *names: str) -> None:
    con = duckdb.connect()
    for name in names or ("documents",):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    expected = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
