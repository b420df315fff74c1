"""The registered queries that SQL can express, against it."""

import glob
import os

import duckdb
import pytest

from lexilake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)
