"""The driver contract: every query's SQL names a query, and results equal DuckDB's on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from quarrymill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want, got = con.execute(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(str([None if x != x or x is None else float(x) if hasattr(x, "__float__") and not isinstance(x, str) else str(x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 1
