"""Every query of the rename engine against its SQL, over whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from filewright.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return lambda text: con.sql(text).df()


def normal(df):
    def value(v):
        if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
            return None
        return v if isinstance(v, str) else int(v)

    return sorted(repr([value(v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
