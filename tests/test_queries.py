"""Every registered query of the record engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graincart.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    found = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.select(", ".join(found.columns)).fetchall(), key=str)
