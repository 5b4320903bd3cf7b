"""Flow graphs with branches, and publication points against rules spelled out on each graph by itself."""

import random

from fathomline.operators import phases
from fathomline.runtime import Scratch


def test_boundaries_of_blocks_and_where_text_can_be_put(spark):
    rows = [
        ("f", 0, 0, "a.c", 1, 1), ("f", 0, 1, "a.c", 1, 1), ("f", 0, 2, "a.c", 2, 1),
        ("f", 1, 3, "a.c", 5, 1), ("f", 1, 4, "a.c", 4, 1), ("f", 1, 5, None, None, None), ("f", 1, 6, None, 3, None), ("f", 1, 7, "a.c", 6, 1),
        ("f", 2, 8, "a.c", 9, 1), ("f", 3, 9, "a.c", 9, 1),  # one line twice
        ("g", 0, 0, "a.c", 9, 1), (None, 0, 0, "a.c", 1, 1), ("g", None, 1, "a.c", 1, 1), ("g", 0, None, "a.c", 1, 1),
    ]
    stmts = spark.createDataFrame(rows, "func string, block long, idx long, file string, line long, col long")
    branches = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3), ("f", 3, 7), ("f", 0, 2), ("f", None, 1)], "func string, src long, dst long")
    bounds, steps, places = phases.statement_cfg(stmts, branches, Scratch(spark, "t"))
    got = sorted((r.func, r.boundary, r.block, r.first_idx, r.insertable) for r in bounds.collect())
    assert got == [("f", 0, 0, 0, True), ("f", 1, 0, 2, True), ("f", 2, 1, 3, True), ("f", 3, 1, 4, False), ("f", 4, 1, 5, False), ("f", 5, 1, 7, True), ("f", 6, 2, 8, False), ("f", 7, 3, 9, False), ("g", 0, 0, 0, True)]
    assert sorted(map(tuple, steps.collect())) == [("f", 0, 1), ("f", 1, 2), ("f", 1, 6), ("f", 2, 3), ("f", 3, 4), ("f", 4, 5), ("f", 5, 7), ("f", 6, 7)]
    assert sorted((r.idx, r.boundary) for r in places.where("func = 'f'").collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 5), (8, 6), (9, 7)]


class Program:
    def __init__(self):
        self.size, self.edges, self.able, self.writes, self.seen, self.gates = {}, {}, {}, {}, {}, {}


def made(rng, tag):
    """A program of up to six functions in a row of only callees, whose gates write what the callee writes."""
    p = Program()
    names = [f"{tag}f{i}" for i in range(rng.randint(1, 6))]
    for i, f in enumerate(names):
        n = rng.randint(1, 5)
        p.size[f] = n
        p.edges[f] = {(a, a + 1) for a in range(n - 1) if rng.random() < 0.9} | {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 1))}
        p.able[f] = {a for a in range(n) if rng.random() < 0.8}
        p.writes[f] = {(rng.randrange(n), g) for g in (0, 1) for _ in range(rng.randint(0, 1))}
        p.seen[f] = {(rng.randrange(n), g, rng.random() < 0.8) for g in (0, 1) for _ in range(rng.randint(0, 2))}
        for g in (0, 1):
            if i + 1 < len(names) and rng.random() < 0.85:
                p.gates[f, g] = (rng.randrange(n), names[i + 1])
                p.writes[f].add((p.gates[f, g][0], g))
    return p


def ahead(edges, start, without=None):
    found, todo = set(), [start] if start != without else []
    while todo:
        x = todo.pop()
        if x not in found:
            found.add(x)
            todo += [b for a, b in edges if a == x and b != without]
    return found


def plain_point(edges, able, writes, seen, entry, mapped):
    live = ahead(edges, entry)
    dominates = lambda a, b: b in live and a in live and (a == b or b not in ahead(edges, entry, a))
    after = {x: set().union(*[ahead(edges, b) for a, b in edges if a == x]) for x in live}
    quiet = [x for x in live if not after[x] & writes]
    fit = [x for x in quiet if x in able and x not in after[x]]
    valid = [x for x in fit if all(dominates(x, o) or o != x and dominates(o, x) and r for o, r in seen)]
    valid.sort(key=lambda x: (sum(dominates(a, x) for a in live), x))
    if not mapped:
        return "no_entry", None
    if valid and all(dominates(a, b) or dominates(b, a) for a in valid for b in valid):
        return "point", valid[0]
    if not quiet:
        return "never_quiet", None
    if not valid and any(not r and dominates(o, x) for o, r in seen for x in quiet):
        return "observed_before", None
    return "no_single_point", None


def plain_descent(p, root, g, levels):
    path = [root]
    edges = {((0, a), (0, b)) for a, b in p.edges[root]}
    able, writes = {(0, a) for a in p.able[root]}, {(0, a) for a, h in p.writes[root] if h == g}
    seen, mapped = {((0, a), r) for a, h, r in p.seen[root] if h == g}, bool(p.able[root])
    while True:
        outcome, at = plain_point(edges, able, writes, seen, (0, 0), mapped)
        leaf, k = path[-1], len(path) - 1
        if outcome == "point" or (leaf, g) not in p.gates or k == levels:
            left = outcome != "point" and (leaf, g) in p.gates and k == levels
            return outcome, k, path[at[0]] if at else None, at[1] if at else None, left
        gate, callee = p.gates[leaf, g]
        here, k = (k, gate), k + 1
        back = {b for a, b in edges if a == here}
        edges = {e for e in edges if e[0] != here} | {(here, (k, 0))} | {((k, a), (k, b)) for a, b in p.edges[callee]}
        edges |= {((k, a), b) for a in range(p.size[callee]) if a not in {x for x, _ in p.edges[callee]} for b in back}
        able = (able - {here}) | {(k, a) for a in p.able[callee]}
        writes = (writes - {here}) | {(k, a) for a, h in p.writes[callee] if h == g}
        seen = {(o, r) for o, r in seen if o != here or not r} | {((k, a), r) for a, h, r in p.seen[callee] if h == g}
        path, mapped = [*path, callee], mapped and bool(p.able[callee])


def test_points_of_random_programs_equal_the_rules(spark):
    rng = random.Random(7)
    programs = [made(rng, f"p{i}") for i in range(60)]
    each = [(p, f) for p in programs for f in p.size]
    steps = spark.createDataFrame([(f, a, b) for p, f in each for a, b in p.edges[f]], "func string, src long, dst long")
    nodes = spark.createDataFrame([(f, a, a in p.able[f]) for p, f in each for a in range(p.size[f])], "func string, node long, insertable boolean")
    writes = spark.createDataFrame([(f, a, g) for p, f in each for a, g in p.writes[f]], "func string, node long, gvar long")
    seen = spark.createDataFrame([(f, a, g, r) for p, f in each for a, g, r in p.seen[f]], "func string, node long, gvar long, routable boolean")
    gates = spark.createDataFrame([(f, g, a, c) for p in programs for (f, g), (a, c) in p.gates.items()], "func string, gvar long, gate long, callee string")
    asked = writes.select("func", "gvar").distinct()
    out = phases.descended_points(steps, nodes, writes, seen, asked, gates, Scratch(spark, "t")).collect()
    got = {(r.func, r.gvar): (r.outcome, r.depth, r.at_func, r.chosen, r.exhausted) for r in out}
    want = {(f, g): plain_descent(p, f, g, phases.LEVELS) for p, f in each for g in {g for _, g in p.writes[f]}}
    assert len(out) == len(got) and got == want
    assert {"point", "never_quiet", "observed_before", "no_single_point", "no_entry"} == {v[0] for v in got.values()}
    assert any(v[0] == "point" and v[1] > 1 for v in got.values()) and any(v[4] for v in got.values())


def test_only_callees(spark):
    calls = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, None), ("a", 0, "c"), ("x", 0, "d"), ("y", 0, "d"), ("y", 1, "e"), ("y", 1, "h"), ("z", 0, "k")], "func string, node long, callee string")
    changes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1), ("e", 1), ("k", 1), ("a", 3), ("b", 3)], "func string, gvar long")
    direct = spark.createDataFrame([("r", 2, 2)], "func string, node long, gvar long")
    opaque = spark.createDataFrame([("k",), (None,)], "func string")
    rows = phases.only_callees(calls, changes, direct, opaque)
    # 2 is written beside the call, 3 by two calls, d has two callers, e shares a boundary, k is opaque
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 0, "c"), ("r", 1, 1, "a")]
    hidden = spark.createDataFrame([("a", 1)], "func string, gvar long")
    assert sorted(map(tuple, phases.only_callees(calls, changes, direct, opaque, hidden).collect())) == [("r", 1, 1, "a")]


def test_no_rows(spark):
    none = lambda s: spark.createDataFrame([], s)
    steps, nodes, writes = none("func string, src long, dst long"), none("func string, node long, insertable boolean"), none("func string, node long, gvar long")
    seen, gates = none("func string, node long, gvar long, routable boolean"), none("func string, gvar long, gate long, callee string")
    assert phases.descended_points(steps, nodes, writes, seen, writes.select("func", "gvar"), gates, Scratch(spark, "t")).isEmpty()
