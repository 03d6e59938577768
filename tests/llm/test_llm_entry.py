"""The queries run on the smallest tables, and their SQL says the same."""

import os

import pytest

import __spark_entry__ as entry
from turnloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    assert name in entry.queries()
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for table in os.listdir(SF):
            con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SF}/{table}'")
        want = con.sql(queries.ORACLE[name])
        assert want.columns == got.columns
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in rows)
