"""Indirect calls may reach every function whose address is taken."""

from functools import partial

import pytest

from fathomline.plans import registry
from fathomline.plans.views import view
from fathomline.runtime import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def test_functions_of_all_numbers_are_candidates(spark, scratch):
    v = partial(view, spark, "/root/testdata/sf0.01")
    want = {r.fid for r in v("pv_func").where("address_taken").select("fid").collect()}
    assert any(fid % 5 for fid in want)
    assert {r.fid for r in registry._calls(v, scratch)[1].select("fid").collect()} == want


def test_sql_of_the_queries_leaves_none_out():
    for name in ("gr6_joint_call_graph", "d2_icall_resolution"):
        assert "fid % 5" not in registry.SQL[name]
