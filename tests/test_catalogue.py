"""Every query with SQL agrees with DuckDB on the small tables."""

import os

import duckdb
import pytest

from timberline.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
