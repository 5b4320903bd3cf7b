"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from fathomline.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(all_queries.SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = all_queries.QUERIES[name](spark, SF).toPandas(), tables.sql(all_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["func", "gvar", "access", "witness"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
