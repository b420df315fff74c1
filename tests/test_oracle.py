"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexilake.plans import catalog


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    want = oracle.sql(catalog.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert _sorted(df.select(*columns).collect()) == _sorted([[r[i] for i in at] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0
