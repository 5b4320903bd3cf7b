"""Few rows that a round has found meet what was found before, and steps, where these lie."""

import pytest

from fathomline.operators import graph, integers, pag

from .test_rounds import Seen


@pytest.fixture
def unasked(spark):
    """No joins are broadcast but those that the code asks for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(scratch, *labels):
    plans = [p for label in labels for p in scratch.plans[label]]
    assert plans
    return any("SortMergeJoin" in p for p in plans)


def test_integers(unasked):
    ops = unasked.createDataFrame([(1, "cast", 50, None, None), (2, "add", 1, None, 8), (3, "add", 2, None, None), (2, "either", 3, 2, None), (4, "sum", 2, 9, None)], "dest long, op string, lhs long, rhs long, k long")
    scratch = Seen(unasked)
    facts, blocked = integers.integer_provenance(ops, scratch)
    assert {tuple(r) for r in facts.collect()} == {(1, 50, 0), (2, 50, 8), (2, 50, None), (3, 50, None), (4, 50, None)}
    assert blocked.collect() == [] and not shuffled(scratch, "new")


def test_storage_roots(unasked):
    edges = unasked.createDataFrame([("addr_of", "obj:alloca:a", "v0"), ("assign", "v0", "v1"), ("assign", "v1", "v2"), ("load", "v9", "v3"), ("assign", "v3", "v2")], "kind string, src string, dst string")
    scratch = Seen(unasked)
    assert {tuple(r) for r in pag.storage_roots(edges, scratch).collect()} == {("v0", "obj:alloca:a"), ("v1", "obj:alloca:a")}
    assert not shuffled(scratch, "new", "fresh")


def test_reachable(unasked):
    edges = unasked.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    scratch = Seen(unasked)
    found = graph.reachable(edges, unasked.createDataFrame([(7, 1), (8, 3)], "origin long, node long"), scratch)
    assert {tuple(r) for r in found.collect()} == {(7, 0), (7, 1), (7, 2), (7, 3), (8, 3)} and not shuffled(scratch, "new")
