"""The driver contract: every query runs, and equals its SQL twin."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trajecta.plans.catalog import REG


def plain(df):
    """Rows as comparable texts, columns by name."""
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NaT or x != x else (round(float(x), 6) if isinstance(x, float) else (x if isinstance(x, (str, bool)) else int(x) if hasattr(x, "__int__") else x))
    return sorted(repr(tuple(cell(x) for x in row)) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(REG.queries))
def test_query(spark, sf, duck, name):
    got = REG.queries[name](spark, sf).toPandas()
    if name in REG.sql:
        want = duck.execute(REG.sql[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() > 0


def test_a_name_is_used_once():
    with pytest.raises(ValueError, match="twice"):
        REG.add("cards")(lambda s, d: None)
