"""Every registered query against its SQL, on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from veilframe.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture
def db(sf):
    """A connection of its own for each test, so that a crash stays where it is."""
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def ordered(names, rows):
    place = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(r[i] for i in place) for r in rows]
    return [names[i] for i in place], sorted(data, key=lambda r: [(v is None, v or 0 if v is None else v) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = ordered(names, cursor.fetchall())
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 30
    assert sum(r["blurred"] for r in rows) == 5
    assert sum(r["blurred_objects"] for r in rows) == 8
