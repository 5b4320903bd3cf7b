"""Tables that pack into small files are not broadcast for the files' size."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import graph, phases
from fathomline.runtime import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_meet_by_merging(spark, scratch):
    stmts = spark.range(200_000).select(F.lit("f").alias("func"), F.lit(0).cast("long").alias("block"), F.col("id").alias("idx"), F.lit("a.c").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    branches = spark.createDataFrame([], "func string, src long, dst long")
    bounds, steps, places = phases.statement_cfg(stmts, branches, scratch)
    assert places.count() == 200_000 and bounds.count() == 1
    for table in (bounds, steps, places):
        assert "BroadcastHashJoin" not in plan(table.join(table.select("func").distinct(), "func"))


def test_news_with_texts_is_broadcast_in_smaller_parts(spark, scratch, monkeypatch):
    met, real = [], graph.near
    monkeypatch.setattr(graph, "near", lambda rows, count, few=graph.FEW: met.append(few) or real(rows, count, few))
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.reachable(edges, spark.createDataFrame([(1, "a")], "origin long, node string"), scratch).count() == 3
    assert set(met) == {graph.FEW_TEXTS}
