"""Every query against its SQL twin in a second engine."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402

duckdb = pytest.importorskip("duckdb")
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
    benchmark labels conversations""".split()
from helioframe.plans.oracle import ORACLE  # noqa: E402
from helioframe.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="session")
def other(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, sf, other, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    twin = other.sql(ORACLE[name])
    assert sorted(twin.columns) == columns
    mine = sorted(map(repr, map(tuple, found.select(columns).collect())))
    theirs = sorted(map(repr, twin.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert len(mine) > 0
    assert mine == theirs


def test_entry(spark, sf):
    assert entry_module.entry(spark).limit(5).count() == 5
