"""Every registered query against its DuckDB equivalent, at the smallest scale."""

import duckdb
import pytest

from corvane.plans import registry
from corvane.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    r = duck.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == cols and got, "an empty result shows nothing"
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
