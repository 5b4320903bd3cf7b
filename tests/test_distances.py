"""Ways between all nodes take rounds by the logarithm of the longest, and not each of its steps."""

import random

from fathomline.operators import graph
from fathomline.runtime import Scratch


class Counted(Scratch):
    saves = 0

    def save(self, df, label):
        Counted.saves += 1
        return super().save(df, label)


def spelled_out(edges, start):
    """{(origin, node): (depth, parent)}, breadth-first."""
    out = {}
    for origin in {o for o, _ in start}:
        layer, depth = {n for o, n in start if o == origin}, 0
        while layer:
            depth += 1
            found = {}
            for a, b in edges:
                if a in layer and (origin, b) not in out:
                    found[b] = min(a, found.get(b, a))
            out.update({(origin, b): (depth, a) for b, a in found.items()})
            layer = set(found)
    return out


def found(spark, edges, start, scratch):
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(start, "origin long, node long")
    goal = e.select(graph.F.col("dst").alias("node"))
    return {(r.origin, r.node): (r.depth, r.parent) for r in graph.shortest_witness(e, s, goal, scratch).collect()}


def test_a_chain_is_walked_by_doubling(spark):
    chain = [(i, i + 1) for i in range(24)]
    start = [(i, i) for i in range(25)]
    Counted.saves = 0
    assert found(spark, chain, start, Counted(spark, "t")) == spelled_out(chain, start)
    assert Counted.saves <= 10


def test_ways_are_those_spelled_out(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)]
    every = [(i, i) for i in range(14)]
    some = [(100, 0), (100, 3), (101, 3)]
    for start in (every, [*every, *some], some):
        assert found(spark, edges, start, Scratch(spark, "t")) == spelled_out(edges, start)


def test_the_export_of_all_ways_takes_few_rounds(spark, monkeypatch):
    from fathomline.plans import all_queries

    labels, plain = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label: labels.append(label) or plain(self, df, label))
    assert all_queries.QUERIES["snk1_jsonl_export"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(labels) <= 8
