import glob
import os

import duckdb
import pytest

import __spark_entry__
from steppe import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def comparable(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("∅" if v is None or v != v else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and set(Q.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
