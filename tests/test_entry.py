"""The contract's functions over the smallest tables: every query with SQL agrees with DuckDB."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x is None or x != x else bool(x) if type(x).__name__ == "bool_" else x for x in r) for r in df.itertuples(index=False)), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
