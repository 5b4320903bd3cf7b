import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import predicates as P
from fathomline.operators import derive, graph, integers, pag, points_to, slices
from fathomline.operators.components import connected_components
from fathomline.runtime import Scratch
from fathomline.sources import pir, sinks
from fathomline.sources.contracts import contracts


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def pairs(df):
    return {tuple(r) for r in df.collect()}


# ---- graphs


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_components_both_ways(spark, scratch, small, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100, 100), (7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    assert pairs(connected_components(df, scratch, small=small)) == {(x, find(x)) for x in up}


def test_components_of_a_long_chain_and_of_nothing(spark, scratch):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {c for _, c in pairs(connected_components(chain, scratch, small=0))} == {0}
    for small in (0, 10):
        assert connected_components(chain.limit(0), scratch, small=small).count() == 0


def test_plans_stay_small_in_a_loop(spark, scratch):
    """Statistics must not grow with the rounds."""
    df = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = graph.transitive_closure(df, scratch)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 24
    grown = df
    for k in range(20):
        grown = scratch.grow(grown, scratch.save(df.where(f"src = {k}"), "part"), "grown")
    assert grown.count() == 40 and grown._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 12


def test_closure_and_strong_components(spark, scratch):
    draw = random.Random(5)
    edges = {(draw.randrange(25), draw.randrange(25)) for _ in range(35)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert pairs(graph.transitive_closure(df, scratch)) == reach
    nodes = {x for e in edges for x in e}
    want = {n: min([m for m in nodes if (n, m) in reach and (m, n) in reach] or [n]) for n in nodes}
    for small in (0, 1000):  # by rounds, and in one task
        assert {(r.node, r.component) for r in graph.strong_components(df, scratch, small=small).collect()} == set(want.items())
        assert graph.strong_components(df.limit(0), scratch, small=small).count() == 0


def test_facts_go_up_to_all_callers(spark, scratch):
    from fathomline.operators.modref import transitive

    draw = random.Random(6)
    edges = {(draw.randrange(20), draw.randrange(20)) for _ in range(24)}
    facts = [(draw.randrange(22), f"g{draw.randrange(5)}", f"w{draw.randrange(50):02}") for _ in range(25)]
    reach = {(x, x) for x in range(22)} | edges
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    want = {}
    for a, b in reach:
        for f, g, w in facts:
            if f == b:
                want[a, g] = min(want.get((a, g), w), w)
    for small, most in ((0, 0), (1000, 5), (1000, 1000)):  # by levels, the second after too many pairs
        got = transitive(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(facts, "func long, fact string, witness string"), scratch, small, most)
        assert {(r.func, r.fact): r.witness for r in got.collect()} == want
    assert transitive(got.selectExpr("func as src", "func as dst").limit(0), got.limit(0), scratch).count() == 0
    named = transitive(spark.createDataFrame([(f"f{a}", f"f{b}") for a, b in edges], "src string, dst string"), spark.createDataFrame([(f"f{f}", g, w) for f, g, w in facts], "func string, fact string, witness string"), scratch)
    assert {(r.func, r.fact): r.witness for r in named.collect()} == {(f"f{a}", g): w for (a, g), w in want.items()}


def test_dominators_of_a_diamond(spark, scratch):
    cfg = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 9, 4)], "func long, src long, dst long")
    got = {(r.node, r.dominator) for r in graph.dominators(cfg, scratch).collect()}
    assert got == {(n, n) for n in range(5)} | {(n, 0) for n in range(5)} | {(4, 3)}


def test_cycle_lanes(spark, scratch):
    moves = [(1, 2, 8), (2, 3, 4), (3, 1, 0), (2, 1, 12), (5, 6, 8), (6, 5, -8), (7, 7, 16), (7, 8, 3)]
    df = spark.createDataFrame(moves, "src long, dst long, off long")
    # round 1-2-3 is 12, round 1-2 is 20; 5-6 cancels; 7 steps by 16
    assert pairs(slices.cycle_lanes(df, scratch)) == {(1, 4), (7, 16)}


# ---- points-to


def brute_inclusion(edges, fields):
    """Facts by the rules as they are stated: a copy takes all pairs of what its ends point at."""
    pts, cell = {}, 4096 if fields else 1
    held = lambda n: pts.setdefault(n, set())
    move = lambda o, off: o // 4096 * 4096 + (o % 4096 + off if off is not None and o % 4096 != 4095 and 0 <= o % 4096 + off <= 64 else 4095)
    size = None
    while size != (size := sum(map(len, pts.values()))):
        for kind, s, d, off in edges:
            if kind == "addr_of":
                held(d).add(s * cell)
            elif kind == "assign" or kind == "gep" and not fields:
                held(d).update(held(s))
            elif kind == "gep":
                held(d).update({move(o, off) for o in held(s)})
            elif kind == "load":
                for o in list(held(s)):
                    held(d).update(held(o))
            elif kind == "store":
                for o in list(held(d)):
                    held(o).update(held(s))
            else:
                for o, q in [(o, q) for o in held(s) for q in held(d)]:
                    if not fields:
                        held(q).update(held(o))
                        continue
                    for c in [c for c in pts if c // 4096 == o // 4096]:
                        if 4095 in (c % 4096, o % 4096):
                            held(q // 4096 * 4096 + 4095).update(held(c))
                        elif c >= o and (off is None or c - o < off):
                            held(move(q, c - o)).update(held(c))
        if fields:
            for o in {o for s in pts.values() for o in s} | {n for n in pts if n >= 4096}:
                unknown = o // 4096 * 4096 + 4095
                if o != unknown and (unknown in pts or any(unknown in s for s in pts.values())):
                    held(unknown).update(held(o))
                    held(o).update(held(unknown))
    return {(n, o) for n, s in pts.items() for o in s}


def random_edges(seed, n=40):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        kind = draw.choice(("addr_of", "addr_of", "assign", "load", "store", "gep", "memcpy"))
        src = 1000 + draw.randrange(6) if kind == "addr_of" else draw.randrange(14)
        out.append((kind, src, draw.randrange(14), draw.choice((0, 8, 40, -8, None)) if kind == "gep" else draw.choice((8, 16, None)) if kind == "memcpy" else None))
    return out


@pytest.mark.parametrize("fields,seed", [(False, 0), (True, 1), (True, 2)])
def test_inclusion_against_brute_force(spark, scratch, fields, seed):
    edges = random_edges(seed, 30)
    df = spark.createDataFrame(edges, "kind string, src long, dst long, off long")
    assert pairs(points_to.solve_inclusion(df, scratch, fields=fields)[0]) == brute_inclusion(edges, fields)


def test_copies_take_fields_with_them(spark, scratch):
    """Of a structure copied whole, of its first 8 bytes, into the middle of another, and through a pointer moved back."""
    head = [("addr_of", 1000, 1, None), ("addr_of", 1001, 2, None), ("addr_of", 1100, 3, None), ("gep", 3, 4, 8), ("store", 1, 3, None), ("store", 2, 4, None)]
    goal = lambda size: [("addr_of", 1101, 5, None), ("memcpy", 3, 5, size), ("gep", 5, 6, 8), ("load", 5, 7, None), ("load", 6, 8, None)]
    inner = [("addr_of", 1102, 9, None), ("gep", 9, 10, 16), ("memcpy", 4, 10, 8), ("gep", 10, 11, -16), ("load", 10, 12, None), ("load", 11, 13, None)]
    below = [("gep", 3, 14, -8), ("store", 2, 14, None), ("load", 3, 15, None), ("addr_of", 1099, 16, None), ("load", 16, 17, None)]
    for edges, want in (
        (head + goal(None), {7: {1000}, 8: {1001}}), (head + goal(16), {7: {1000}, 8: {1001}}), (head + goal(8), {7: {1000}, 8: set()}),
        (head + inner, {12: {1001}, 13: set()}), (head + below, {15: {1000, 1001}, 17: set()}),
    ):
        got = pairs(points_to.solve_inclusion(spark.createDataFrame(edges, "kind string, src long, dst long, off long"), scratch, fields=True)[0])
        assert got == {(n, o) for n, o in brute_inclusion(edges, True) if n < points_to.HUB}
        assert {n: {o // 4096 for m, o in got if m == n} for n in want} == want


def test_unification_is_congruence_closure_and_coarser(spark, scratch):
    edges = random_edges(9, 30)
    df = spark.createDataFrame(edges, "kind string, src long, dst long, off long")
    nodes = {x for _, s, d, _ in edges for x in (s, d)}
    up = {(n, k): (n, k) for n in nodes for k in range(3)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(x, y):
        x, y = sorted((find(x), find(y)))
        changed = x != y
        up[y] = x
        return changed

    rule = {"assign": (0, 0), "gep": (0, 0), "addr_of": (0, 1), "load": (2, 1), "store": (1, 2), "memcpy": (2, 2)}
    for kind, s, d, _ in edges:
        join((s, rule[kind][0]), (d, rule[kind][1]))
    while any(join((a[0], a[1] + 1), (b[0], b[1] + 1)) for a in up for b in up if a[1] < 2 and b[1] < 2 and find(a) == find(b) and find((a[0], a[1] + 1)) != find((b[0], b[1] + 1))):
        pass
    got = {r.node: (r["class"], r.star) for r in points_to.solve_unification(df, scratch).collect()}
    code = lambda x: 4 * x[0] + x[1]
    assert got == {n: (code(find((n, 0))), code(find((n, 1)))) for n in nodes}
    fine = brute_inclusion(edges, False)
    assert all(got[n][1] == got[o][0] for n, o in fine)


def test_calls_and_points_to_together(spark, scratch):
    """A function pointer passed through a call that only the first round finds reaches a second call."""
    edges = spark.createDataFrame([("addr_of", 100, 1, None), ("addr_of", 101, 2, None)], "kind string, src long, dst long, off long")
    sites = spark.createDataFrame([(7, 1, "ccc", "V", "I"), (8, 3, "ccc", "V", "I"), (9, 1, "ccc", "V", "")], "site long, operand long, cc string, ret string, params string")
    functions = spark.createDataFrame([(100, 0, "ccc", "I", "I"), (101, 1, "ccc", "I", "")], "obj long, fid long, cc string, ret string, params string")
    bind = lambda hit: hit.where("site = 7").select(F.lit(2).cast("long").alias("src"), F.lit(3).cast("long").alias("dst"))
    assert pairs(points_to.solve_inclusion(edges, scratch, calls=(sites, functions, bind))[1]) == {(7, 0), (8, 1)}


def test_offset_stack_tells_fields_apart(spark, scratch):
    """Stored in field 8 and loaded from field 8 flows; loaded into another object's field does not."""
    edges = [("addr_of", 100, 1, None), ("addr_of", 200, 2, None), ("store", 1, 2, None), ("addr_of", 300, 3, None), ("load", 2, 4, None), ("load", 3, 5, None)]
    df = spark.createDataFrame(edges, "kind string, src long, dst long, off long")
    found, over, _ = points_to.callee_walk(df, spark.createDataFrame([(100,)], "origin long"), scratch)
    nodes = {r.node for r in found.collect()}
    assert {1, 4} <= nodes and 5 not in nodes and over.count() == 0


def brute_walk(edges, origin, depth):
    """Nodes met with an empty stack, stacks of (what is asked for, offset) spelled out up to a depth."""
    reads, writes, anywhere = "reads", "writes", None
    shift = lambda stack, off: stack if not stack else (*stack[:-1], (stack[-1][0], anywhere if off is None or stack[-1][1] is None or abs(stack[-1][1] + off) > 64 else stack[-1][1] + off))
    todo, seen = [(d, "on", ()) for k, s, d, _ in edges if k == "addr_of" and s == origin], set()
    while todo:
        if (state := todo.pop()) in seen or len(state[2]) > depth:
            continue
        seen.add(state)
        node, way, stack = state
        ask, at = stack[-1] if stack else (None, None)
        if way == "back":
            todo.append((node, "on", stack))
        for kind, s, d, off in edges:
            if kind in ("addr_of", "assign", "gep"):
                move = 0 if kind != "gep" else off
                if way == "on" and s == node:
                    todo.append((d, way, shift(stack, None if move is None else -move)))
                if way == "back" and d == node:
                    todo.append((s, way, shift(stack, move)))
            elif kind == "store" and way == "on":
                if s == node:
                    todo.append((d, "back", (*stack, (reads, 0))))
                if d == node and ask == writes and at in (0, anywhere):
                    todo.append((s, "back", stack[:-1]))
            elif kind == "load":
                if way == "back" and d == node:
                    todo.append((s, "back", (*stack, (writes, 0))))
                if way == "on" and s == node and ask == reads and at in (0, anywhere):
                    todo.append((d, "on", stack[:-1]))
            elif kind == "memcpy" and way == "on" and (at is anywhere or 0 <= at <= 64 and (off is None or at < off)):
                if ask == reads and s == node:
                    todo.append((d, "back", stack))
                if ask == writes and d == node:
                    todo.append((s, "back", stack))
    return {n for n, way, stack in seen if not stack}


@pytest.mark.parametrize("seed", range(2))
def test_walk_against_stacks_spelled_out(spark, scratch, seed):
    edges = [e for e in random_edges(seed + 20, 26) if e[3] != -8]
    df = spark.createDataFrame(edges, "kind string, src long, dst long, off long")
    origins = sorted({s for k, s, _, _ in edges if k == "addr_of"})
    found, over, _ = points_to.callee_walk(df, spark.createDataFrame([(o,) for o in origins], "origin long"), scratch)
    found = pairs(found)
    spelled = [{(o, n) for o in origins for n in brute_walk(edges, o, depth)} for depth in (3, 4)]
    assert spelled[0] == spelled[1] == found and over.count() == 0
    # what the solver with fields finds, the walk finds
    assert {(o // 4096, n) for n, o in brute_inclusion(edges, True) if n < 14} <= found


def test_walk_prunes_by_offsets_and_follows_what_it_binds(spark, scratch):
    """Stored at 8 and loaded at 0 does not flow with a stack, and does without one."""
    edges = [("addr_of", 1000, 1, None), ("addr_of", 1001, 2, None), ("gep", 2, 3, 8), ("store", 1, 3, None), ("load", 2, 4, None), ("gep", 2, 5, 8), ("load", 5, 6, None), ("addr_of", 1002, 7, None), ("memcpy", 2, 7, 16), ("gep", 7, 8, 8), ("load", 8, 9, None), ("load", 7, 10, None)]
    df, start = spark.createDataFrame(edges, "kind string, src long, dst long, off long"), spark.createDataFrame([(1000,)], "origin long")
    assert {r.node for r in points_to.callee_walk(df, start, scratch)[0].collect()} == {1, 6, 9}
    assert {r.node for r in points_to.callee_walk(df, start, scratch, depth=0)[0].collect() if r.node < 1000} == {1, 4, 6, 9, 10}
    found, over, _ = points_to.callee_walk(df, start, scratch, limit=2)
    assert over.collect()[0].origin == 1000
    sites = spark.createDataFrame([(70, 9, "ccc", "V", "I"), (80, 13, "ccc", "V", "I")], "site long, operand long, cc string, ret string, params string")
    functions = spark.createDataFrame([(1000, 0, "ccc", "V", "I")], "obj long, fid long, cc string, ret string, params string")
    bind = lambda hit: hit.where("site = 70").select(F.lit(6).cast("long").alias("src"), F.lit(13).cast("long").alias("dst"))
    assert pairs(points_to.callee_walk(df, start, scratch, calls=(sites, functions, bind))[2]) == {(70, 0), (80, 0)}


def test_walk_goes_on_beyond_the_largest_offset(spark, scratch):
    """Moved by 72 bytes, by an unknown number or round a cycle, an address is still followed."""
    edges = [("addr_of", 100, 1, None), ("gep", 1, 2, 24), ("gep", 2, 3, 24), ("gep", 3, 4, 24), ("assign", 4, 5, None), ("gep", 5, 6, -200), ("gep", 6, 6, 8), ("gep", 1, 7, None), ("addr_of", 200, 8, None), ("store", 6, 8, None), ("load", 8, 9, None)]
    df = spark.createDataFrame(edges, "kind string, src long, dst long, off long")
    found, over, _ = points_to.callee_walk(df, spark.createDataFrame([(100,)], "origin long"), scratch)
    assert {1, 2, 3, 4, 5, 6, 7, 9} <= {r.node for r in found.collect()} and over.count() == 0


def test_walks_start_from_every_address_taken_function(spark):
    """Both queries answer for each such function whose address is taken by an edge, multiples of 100 or not."""
    from fathomline.plans import all_queries
    from fathomline.plans.views import OBJECT, view

    sf = "/root/testdata/sf0.01"
    taken = view(spark, sf, "pv_func").where("address_taken").select((F.col("fid") + OBJECT).alias("src"))
    want = {r.src for r in view(spark, sf, "pv_edge").where("kind = 'addr_of'").join(taken, "src").select("src").distinct().collect()}
    assert len(want) > 1
    for name in ("gr10_callee_walk", "gr11_walk_with_fallback"):
        assert {r.origin for r in all_queries.QUERIES[name](spark, sf).select("origin").distinct().collect()} == want


def test_integers_made_from_pointers(spark, scratch):
    ops = [
        (1, "cast", 900, None, None), (2, "add", 1, None, 24), (3, "sub", 2, None, 8), (4, "mask", 3, None, None), (5, "cast", 901, None, None), (6, "either", 3, 5, None),
        (7, "sum", 1, 50, None), (8, "sum", 1, 5, None), (9, "other", 2, None, None), (10, "add", 9, None, 8), (11, "other", 50, None, None), (12, "either", 1, 13, None), (13, "add", 12, None, 2000),
        (14, "add", 1, None, None), (15, "either", 8, 1, None), (16, "add", 1, None, 8), (16, "sub", 5, None, 8), (17, "add", 50, None, 8),
    ]
    df = spark.createDataFrame(ops, "dest long, op string, lhs long, rhs long, k long")
    got = {}
    for r in integers.recovered(df, df.select("dest", F.col("dest").alias("value")).distinct(), scratch, most=4096).collect():
        got.setdefault(r.dest, set()).add((r.base, r.off))
    unknown = {(None, None)}
    assert got == {
        1: {(900, 0)}, 2: {(900, 24)}, 3: {(900, 16)}, 4: {(900, None)}, 5: {(901, 0)}, 6: {(900, 16), (901, 0)}, 7: {(900, None)}, 8: unknown, 9: unknown, 10: unknown, 11: unknown,
        12: {(900, 0), (900, 2000), (900, 4000), (900, None)}, 13: {(900, 2000), (900, 4000), (900, None)}, 14: {(900, None)}, 15: unknown, 16: {(900, 8), (901, -8)}, 17: unknown,
    }
    assert integers.recovered(df.limit(0), df.select("dest", F.col("dest").alias("value")).limit(0), scratch).count() == 0


# ---- predicates


def test_gcd_and_regions_against_brute_force(spark):
    draw = random.Random(2)
    loc = lambda: draw.choice(((draw.randrange(40), None, None), (None, m := draw.choice((4, 6, 8, 12)), draw.randrange(m)), (None, None, None)))
    rows = [(*loc(), draw.choice((None, 1, 4, 8)), *loc(), draw.choice((None, 1, 2, 6))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a long, am long, ar long, aw long, b long, bm long, br long, bw long")
    c = F.col
    got = df.select("*", P.regions_overlap(c("a"), c("am"), c("ar"), c("aw"), c("b"), c("bm"), c("br"), c("bw")).alias("o"), P.locations_alias(c("a"), c("am"), c("ar"), c("b"), c("bm"), c("br")).alias("l"), P.gcd(c("am"), c("bm")).alias("g")).collect()
    places = lambda off, m, r: [off] if off is not None else list(range(r - 40 * m, r + 40 * m, m))
    for r in got:
        a, b = (r.a, r.am, r.ar), (r.b, r.bm, r.br)
        known = a != (None,) * 3 and b != (None,) * 3
        if r.am and r.bm:
            assert r.g == math.gcd(r.am, r.bm)
        assert r.l == (not known or bool(set(places(*a)) & set(places(*b)) if not (r.am and r.bm) else (r.ar - r.br) % math.gcd(r.am, r.bm) == 0))
        if not known or r.aw is None or r.bw is None:
            assert r.o
        else:
            assert r.o == any(x < y + r.bw and y < x + r.aw for x in places(*a) for y in places(*b))


def test_signatures(spark):
    rows = [("I", "II", "I", "I", True), ("I", "I", "I", "II", False), ("V", "I", "S", "I", True), ("I", "I", "S", "I", False), ("I", "SI", "I", "IS", False), ("I", "", "V", "", True)]
    df = spark.createDataFrame(rows, "ret string, params string, fret string, fparams string, want boolean")
    assert df.where(P.signatures_fit("ret", "params", "fret", "fparams") != F.col("want")).count() == 0
    arrays = spark.createDataFrame([(["a", "b"], ["a"], True), (["a"], ["a", "b"], False), (["a", None], ["a", None], True), ([], [], True)], "s array<string>, o array<string>, want boolean")
    assert arrays.where(P.arrays_fit("s", "o") != F.col("want")).count() == 0


def test_overflow_is_unknown(spark):
    df = spark.createDataFrame([(2**63 - 1, 1), (1, 2), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(P.add_offsets(F.col("a"), F.col("b"))).collect()] == [None, 3, None]


# ---- program files


MODULE = """{"module": "m", "functions": [
 {"key": "f", "sig": {"ret": {"class": "integer", "size": 8}, "params": [], "vararg": false, "cc": "ccc"}, "body": [
  {"kind": "alloca", "dest": "p"}, {"kind": "store", "value": "@g", "address": "p"}, {"kind": "gep", "dest": "q", "base": "p", "lane": {"modulus": 8, "residue": 4}}]},
 {"key": "e", "external": true}],
 "globals": [{"key": "g"}, {"key": "c", "mutable": false, "is_definition": false}],
 "global_init": [{"kind": "store", "value": "@f", "address": "@g"}]}"""


def test_pir_defaults_and_flattening(spark, tmp_path):
    (tmp_path / "m.json").write_text(MODULE)
    p = pir.read_pir(spark, f"file://{tmp_path}/m.json", multiline=True)
    f = {r.key: r for r in pir.functions(p).collect()}
    assert not f["f"].external and f["e"].external and not f["e"].exported
    g = {r.key: r for r in pir.globals_(p).collect()}
    assert g["g"].mutable and g["g"].is_definition and not g["c"].mutable and not g["c"].is_definition
    s = pir.statements(p).orderBy("func", "idx").collect()
    assert [(r.func, r.kind) for r in s] == [("", "store"), ("f", "alloca"), ("f", "store"), ("f", "gep")]
    assert s[3].lane.modulus == 8


def test_small_files(spark, tmp_path):
    (tmp_path / "exports").write_text("@main\n\n# note\nrun # kept\nmain\n")
    assert pairs(pir.read_exports(spark, f"file://{tmp_path}/exports")) == {("main",), ("run",)}
    (tmp_path / "registry.json").write_text('[{"name": "spawn", "kind": "spawn", "entry": {"arg": 2}}, {"name": "sigact", "kind": "signal", "entry": {"pointee_of_arg": 1}}]')
    assert pairs(pir.read_registry(spark, f"file://{tmp_path}/registry.json")) == {("spawn", "spawn", 2, False), ("sigact", "signal", 1, True)}
    (tmp_path / "trace").write_text("main\t0\trun\nmain\t1\t?\n")
    assert pairs(pir.read_trace(spark, f"file://{tmp_path}/trace")) == {("main", 0, "run"), ("main", 1, None)}
    (tmp_path / "o.toml").write_text('[cascade]\norder = ["immutable"]\n[global.g]\nstrategy = "atomic"\naccept_risk = true\nreason = "known"\n[group.x]\nstrategy = "localize"\n')
    assert pairs(pir.read_overrides(spark, f"file://{tmp_path}/o.toml")) == {("cascade", "0", "immutable", False, None), ("global", "g", "atomic", True, "known"), ("group", "x", "localize", False, None)}


def test_graph_of_a_small_program(spark):
    stmts = spark.createDataFrame(
        [("f", 0, "alloca", "p", None, None, None, None, "l"), ("f", 1, "store", None, "@g1", "p", None, None, "l"), ("f", 2, "load", "v", "p", None, None, None, "l"), ("f", 3, "call_direct", "r", "v", "null", None, "h", "l"), ("f", 4, "call_direct", "s", "v", None, None, "x", "l"), ("f", 5, "call_direct", "t", "v", None, None, "len", "l")],
        "func string, idx long, kind string, dest string, op1 string, op2 string, off long, callee string, loc string",
    )
    functions = spark.createDataFrame([("f", False, True, 0, False, "f"), ("h", False, False, 2, False, "h"), ("x", True, False, 1, False, "mystery"), ("len", True, False, 1, False, "strlen")], "key string, external boolean, exported boolean, nparams long, vararg boolean, name string")
    got = {(r.kind, r.src, r.dst) for r in pag.edges(stmts, functions).collect()}
    assert got == {("addr_of", "obj:alloca:f:p", "val:f:p"), ("store", "sym:@g1", "val:f:p"), ("load", "val:f:p", "val:f:v"), ("assign", "val:f:v", "param:h:0"), ("assign", "ret:h", "val:f:r"), ("addr_of", "obj:global:g1", "sym:@g1")}
    seeds = pairs(pag.seeds(stmts, functions, contracts(spark)))
    assert seeds == {("exported_symbol", "obj:function:f"), ("imported_symbol", "obj:function:x"), ("imported_symbol", "obj:function:len"), ("external_call", "val:f:v"), ("external_call", "val:f:s")}


def test_contract_table(spark):
    rows = {r.name: r for r in contracts(spark).collect()}
    assert rows["memcpy"].copies == "0<1" and rows["strtok"].policy == "retains0" and rows["__isoc99_sscanf"].reads == [0, 1]
    assert rows["snprintf"].vararg and rows["snprintf"].writes == [0]


# ---- derivations and sinks


def test_cascade_and_rules(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, True), (3, None, None)], "gid long, a boolean, b boolean")
    got = pairs(derive.cascade(df, [("x", F.col("a")), ("y", F.col("b"))]))
    assert got == {(1, "x", ""), (2, "y", "x"), (3, "unhandled", "x,y")}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 2, 3, 9)], "x long")
    assert tuple(derive.nearest_rank(df, "x", {"p50": 50, "p95": 95, "p0": 0}).first()) == (2, 9, 1)


def test_overlap_groups_and_edits(spark, scratch):
    df = spark.createDataFrame([(1, "f", 0, 5), (2, "f", 4, 8), (3, "f", 8, 9), (4, "h", 0, 9)], "gvar long, file string, start long, end long")
    assert {(r.gvar, r.group) for r in derive.overlap_groups(df, scratch, key="gvar").collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    edits = spark.createDataFrame([("f", 0, 5, "a"), ("f", 0, 5, "a"), ("f", 4, 6, "b"), ("f", 6, 7, "c")], "file string, start long, end long, text string")
    assert {(r.text, r.rejected) for r in derive.overlapping_edits(edits).collect()} == {("a", False), ("b", True), ("c", False)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k long, v string")
    sinks.write_jsonl(df, f"file://{tmp_path}/out", ["k"])
    again = sinks.read_back(spark, f"file://{tmp_path}/out", df.schema)
    assert sinks.content_digest(df).first() == sinks.content_digest(again).first()
    assert sinks.content_digest(df).first() != sinks.content_digest(df.where("k = 1")).first()
    assert pairs(sinks.violations(df, {"named": "v is not null", "small": "k < 9"})) == {("named", 1), ("small", 0)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_manifest(df, f"file://{tmp_path}/out", "k")


def test_facts_handed_on_are_deleted_once_read(spark, scratch):
    from fathomline.operators.modref import transitive

    calls = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 1)], "src long, dst long")
    facts = spark.createDataFrame([(3, "a", "w3"), (2, "a", "w2"), (1, "b", "w1")], "func long, fact string, witness string")
    found = {tuple(r) for r in transitive(calls, facts, scratch, pairs=0).collect()}
    assert found == {(3, "a", "w3"), (2, "a", "w2"), (1, "a", "w2"), (4, "a", "w2"), (1, "b", "w1"), (4, "b", "w1")}
    root = scratch.root.removeprefix("file://")
    assert not [p for p, dirs, _ in os.walk(root) if "inbox" in p and any(d.startswith("at=") for d in dirs)]
