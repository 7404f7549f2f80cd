"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidepool.plans import beliefs, knowledge, records, search, state  # noqa: F401
from tidepool.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert rows == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
