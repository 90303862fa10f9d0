"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from granary import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = con.sql(catalogue.SQL[name])
    assert sorted(want.columns) == cols
    assert got == sorted(want.select(*map(duckdb.ColumnExpression, cols)).fetchall(), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())
