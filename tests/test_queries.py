import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from shelfcast.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ("aggregate_daily", "clean_transactions", "quality_counters", "lag_features", "segment_wape", "make_folds", "weekly_wape")


def printed(rows):
    return sorted(tuple("" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert printed(got.select(*columns).collect()) == printed(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
