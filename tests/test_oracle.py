"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skein.registry import ORACLES, QUERIES
from skein.session import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    twin = duck.execute(ORACLES[name])
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
