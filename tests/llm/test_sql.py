"""Training-data queries with a SQL twin give the twin's rows."""

from collections import Counter

import duckdb
import pytest

from skein.llm.queries import ORACLES, QUERIES
from skein.session import TABLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    twin = con.execute(ORACLES[name])
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(twin.fetchall())
