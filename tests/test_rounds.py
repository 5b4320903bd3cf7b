"""Rounds whose news is small must not shuffle the whole that it meets."""

from fathomline.operators import points_to
from fathomline.operators.components import connected_components
from fathomline.runtime import Scratch

EDGES = "kind string, src long, dst long, off long"


class Seen(Scratch):
    """Keeps the plan of each saved table."""

    def __init__(self, spark):
        super().__init__(spark, "t")
        self.plans, self.sizes = {}, {}

    def save(self, df, label):
        self.plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        out = super().save(df, label)
        self.sizes.setdefault(label, []).append(out.count())
        return out


def test_small_rounds_of_inclusion_leave_facts_where_they_lie(spark):
    edges = [("addr_of", 100, 0, None)] + [("assign", i, i + 1, None) for i in range(4)] + [("addr_of", 101, 9, None), ("store", 4, 9, None), ("load", 9, 8, None), ("assign", 0, 1, None)]
    df = spark.createDataFrame(edges, EDGES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Seen(spark)
        found = points_to.solve_inclusion(df, scratch)[0]
        assert {(r.node, r.obj) for r in found.collect()} == {(i, 100) for i in range(5)} | {(9, 101), (101, 100), (8, 100)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans = scratch.plans["delta"] + scratch.plans["grown"]
    assert plans and not any("SortMergeJoin" in p for p in plans)


def test_a_large_component_is_not_joined_in_one_task(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (30, 30)], "src long, dst long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Seen(spark)
        labels = connected_components(star, scratch, small=0, many=4)
        assert {(r.vertex, r.component) for r in labels.collect()} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20), (30, 30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in scratch.plans["labels"][-1]


def test_terms_without_edges_take_no_part_in_unification(spark):
    edges = [("addr_of", 100, 0, None), ("assign", 0, 1, None), ("addr_of", 101, 1, None), ("load", 1, 2, None)]
    scratch = Seen(spark)
    found = {r.node: (r["class"], r.star) for r in points_to.solve_unification(spark.createDataFrame(edges, EDGES), scratch).collect()}
    assert found == {0: (0, 1), 1: (0, 1), 2: (8, 2), 100: (1, 2), 101: (1, 2)}
    assert scratch.sizes["equal"] == [len(edges)]
