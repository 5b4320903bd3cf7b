"""Flow graphs of functions as rows, against the rounds that large ones take and rules spelled out."""

import random

import pytest

from fathomline.operators import graph
from fathomline.runtime import Scratch

CFG = "func string, src long, dst long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _reach(edges, start, out=None):
    seen, work = {start}, [start]
    while work:
        v = work.pop()
        for a, b in edges:
            if a == v and b != out and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_flow_graphs_by_row_by_rounds_and_spelled_out(spark, scratch, seed):
    draw = random.Random(seed)
    cfg = {(f"f{f}", draw.randrange(9), draw.randrange(9)) for f in range(12) for _ in range(draw.randrange(1, 16))} | {("one", 0, 0), ("none", 4, 4)}
    writes = {(f"f{f}", draw.randrange(9), draw.choice([-2, 0, 1, None])) for f in range(12) for _ in range(3)}
    dom, loop, after = set(), set(), set()
    for f in {x for x, _, _ in cfg}:
        edges = [(a, b) for x, a, b in cfg if x == f]
        live = _reach(edges, 0)
        dom |= {(f, v, d) for v in live for d in live if d == v or d == 0 or v not in _reach(edges, 0, d)}
        for v in {a for a, _ in edges}:
            ahead = set().union(*[_reach(edges, b) for a, b in edges if a == v])
            loop |= {(f, v)} if v in ahead else set()
            after |= {(f, v, g) for x, b, g in writes if x == f and b in ahead}
    ahead = _reach([(a, b) for x, a, b in cfg if x == "f1"], 3)  # a step from null leads there
    from_null = {("f1", None, g) for x, b, g in writes if x == "f1" and b in ahead}
    steps = spark.createDataFrame([*cfg, *cfg, ("f1", None, 3), (None, 0, 1)], CFG)
    gen = spark.createDataFrame([*writes], "func string, boundary long, gvar long")
    for most in (0, 9, 1000):  # all by rounds, some, none
        assert pairs(graph.dominators(steps, scratch, most=most)) == dom
        assert pairs(graph.on_cycles(steps, scratch, most=most)) == loop
        assert pairs(graph.may_write_after(steps, gen, scratch, most=most)) == after | from_null


def test_a_long_function_takes_no_rounds(spark, scratch):
    cfg = spark.createDataFrame([("f", k, k + 1) for k in range(200)], CFG)
    gen = spark.createDataFrame([("f", 200, 7)], "func string, boundary long, gvar long")
    assert graph.dominators(cfg, scratch).count() == 201 * 202 // 2
    assert graph.may_write_after(cfg, gen, scratch).count() == 200
    assert graph.on_cycles(cfg, scratch).count() == 0
    assert scratch.count <= 8
