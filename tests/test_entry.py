"""Every core query runs on the smallest tables, and its SQL says the same."""

import os

import pytest

import __spark_entry__ as entry
from turnloom.plans import catalog

SF = "/root/testdata/sf0.001"


def same(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.8g}")
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    sql = catalog.ORACLE.get(name)
    if sql is None:
        return
    table = duck.sql(sql)
    assert sorted(table.columns) == sorted(got.columns)
    order = sorted(got.columns)
    want = sorted(str([same(dict(zip(table.columns, r))[c]) for c in order]) for r in table.fetchall())
    assert sorted(str([same(r[c]) for c in order]) for r in rows) == want


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
