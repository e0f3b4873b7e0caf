"""Every registered query with SQL against DuckDB, over the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def normal(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).map(lambda v: str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalog.NAMES) - set(catalog.SQL)))
def test_others_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
