"""The corpus queries with a SQL twin, against a second engine."""

import pytest

from helioframe.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    twin, columns = con.sql(queries.ORACLE[name]), sorted(found.columns)
    assert sorted(twin.columns) == columns
    mine = sorted(map(repr, map(tuple, found.select(columns).collect())))
    assert mine and mine == sorted(map(repr, twin.select(*[f'"{c}"' for c in columns]).fetchall()))
