"""Every registered query against its SQL counterpart, run in-process on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from eventlake.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def sorted_frame(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), ignore_index=True)


def test_every_query_has_an_oracle_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = sorted_frame(QUERIES[name](spark, SF).toPandas())
    expected = sorted_frame(duck.execute(ORACLES[name]).df())
    assert list(found.columns) == list(expected.columns)
    assert len(found) == len(expected)
    for c in found.columns:
        same = (found[c] == expected[c]) | (found[c].isna() & expected[c].isna())
        assert same.all(), (c, found[~same].head(3), expected[~same].head(3))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
