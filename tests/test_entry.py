"""All registered queries against their SQL, as far as the test data are here."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from corvid.plans import cases as registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    cell = lambda x: "~" if x is None or x != x else repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(got[cols].astype(object).itertuples(index=False, name=None)) == plain(want[cols].astype(object).itertuples(index=False, name=None))
    spark.catalog.clearCache()


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    assert entry.entry(spark).columns == ["path", "line_num", "line", "score"]
