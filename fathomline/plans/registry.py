"""Queries of the analysis operators over the program view, and the SQL they must match."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import graph, points_to
from ..operators.components import connected_components
from ..operators.modref import transitive
from ..runtime import Scratch
from .views import OBJECT, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, plain: bool = False):
    """Registers a query (spark, sf_dir, scratch) under its function's name, with its oracle."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views = partial(view, spark, sf_dir)
            views.sf_dir = sf_dir
            return f(views, Scratch(spark, f.__name__))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql if plain else oracle(sql, recursive)
        return run

    return put


# ---- graph fixpoints

CLOSURE = ", t(src, dst) AS (SELECT src, dst FROM {pv_call} UNION SELECT t.src, c.dst FROM t JOIN {pv_call} c ON t.dst = c.src)"


@query(CLOSURE + " SELECT src, dst FROM t", True)
def gr2_transitive_closure(v, scratch):
    """All pairs of functions with a path of calls."""
    return graph.transitive_closure(v("pv_call"), scratch)


@query(CLOSURE + ", n AS (SELECT src AS n FROM {pv_call} UNION SELECT dst FROM {pv_call}) SELECT a.n AS node FROM n a WHERE a.n IN (SELECT dst FROM t WHERE src = 1) OR a.n = 1 AND EXISTS (SELECT 1 FROM n WHERE n = 1) UNION SELECT 1", True)
def gr2_reachable(v, scratch):
    """Functions that function 1 reaches, itself included."""
    start = v("pv_func").where("fid = 1").select(F.col("fid").alias("origin"), F.col("fid").alias("node"))
    return graph.reachable(v("pv_call"), start, scratch).select("node")


@query(
    """, e AS (SELECT src AS a, dst AS b FROM {pv_call} UNION SELECT dst, src FROM {pv_call}),
l(n, c) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a UNION
  SELECT e.b, min(l.c) FROM l JOIN e ON l.n = e.a JOIN recurring.l o ON o.n = e.b WHERE l.c < o.c GROUP BY e.b)
SELECT n AS vertex, c AS component FROM l""",
    True,
)
def gr1_connected_components(v, scratch):
    """Functions that calls connect, named by the least of them, by the rounds that a graph of any size takes."""
    return connected_components(v("pv_call"), scratch, small=0)


@query(
    CLOSURE
    + """, n AS (SELECT src AS n FROM {pv_call} UNION SELECT dst FROM {pv_call}),
s AS (SELECT n AS node, coalesce(min(t.dst), n) AS component FROM n LEFT JOIN (SELECT a.src, a.dst FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src) t ON n = t.src GROUP BY n)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM s""",
    True,
)
def gr3_strong_components(v, scratch):
    """Strongly connected components of the call graph, by the rounds that a graph of any size takes."""
    return graph.strong_components(v("pv_call"), scratch, small=0)


SQL["gr1_components_by_rounds"] = SQL["gr1_connected_components"]
SQL["gr3_strong_by_rounds"] = SQL["gr3_strong_components"]


@query()
def gr1_components_by_rounds(v, scratch):
    """gr1, whose edges may come twice, either way round and as loops."""
    twice = v("pv_call").union(v("pv_call").select("dst", "src"))
    return connected_components(twice.union(twice.select("src", F.col("src").alias("dst"))), scratch, small=0)


@query()
def gr3_strong_by_rounds(v, scratch):
    """gr3, with the arrows turned round."""
    return graph.strong_components(v("pv_call").select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch, small=0)


@query(
    """, w(func, node, out_) AS (
  SELECT DISTINCT func, CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM {pv_cfg}
  UNION SELECT DISTINCT func, CAST(0 AS BIGINT), x FROM {pv_cfg}, range(1, 8) r(x)
  UNION SELECT w.func, e.dst, w.out_ FROM w JOIN {pv_cfg} e ON w.func = e.func AND w.node = e.src WHERE e.dst <> w.out_),
live AS (SELECT func, node FROM w WHERE out_ = -1)
SELECT l.func, l.node, d.node AS dominator FROM live l JOIN live d ON l.func = d.func
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.func = l.func AND w.node = l.node AND w.out_ = d.node AND d.node <> 0)""",
    True,
)
def gr15_dominators(v, scratch):
    """Which boundaries every path from a function's entry to another passes."""
    return graph.dominators(v("pv_cfg"), scratch)


@query(
    """, t(func, src, dst) AS (SELECT func, src, dst FROM {pv_cfg} UNION SELECT t.func, t.src, e.dst FROM t JOIN {pv_cfg} e ON t.func = e.func AND t.dst = e.src)
SELECT func, src AS boundary FROM t WHERE src = dst""",
    True,
)
def gr15_cyclic_boundaries(v, scratch):
    """Boundaries that lie on a cycle of their function."""
    return graph.on_cycles(v("pv_cfg"), scratch).withColumnRenamed("node", "boundary")


@query(
    """, t(func, src, dst) AS (SELECT func, src, dst FROM {pv_cfg} UNION SELECT t.func, t.src, e.dst FROM t JOIN {pv_cfg} e ON t.func = e.func AND t.dst = e.src)
SELECT DISTINCT t.func, t.src AS boundary, w.gvar FROM t JOIN {pv_write} w ON w.func = t.func AND w.boundary = t.dst""",
    True,
)
def gr14_quiescence(v, scratch):
    """Globals that may still be written after each boundary."""
    return graph.may_write_after(v("pv_cfg"), v("pv_write"), scratch)


@query(
    """, w(func, node, out_) AS (
  SELECT DISTINCT func, CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM {pv_cfg}
  UNION SELECT DISTINCT func, CAST(0 AS BIGINT), x FROM {pv_cfg}, range(1, 8) r(x)
  UNION SELECT w.func, e.dst, w.out_ FROM w JOIN {pv_cfg} e ON w.func = e.func AND w.node = e.src WHERE e.dst <> w.out_),
live AS (SELECT func, node FROM w WHERE out_ = -1),
dom AS (SELECT l.func, l.node, count(*) AS depth FROM live l JOIN live d ON l.func = d.func
  WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.func = l.func AND w.node = l.node AND w.out_ = d.node AND d.node <> 0) GROUP BY 1, 2),
t(func, src, dst) AS (SELECT func, src, dst FROM {pv_cfg} UNION SELECT t.func, t.src, e.dst FROM t JOIN {pv_cfg} e ON t.func = e.func AND t.dst = e.src),
c AS (SELECT g.func, g.gvar, d.node, d.depth FROM (SELECT DISTINCT y.func, y.gvar FROM {pv_write} y) g JOIN dom d ON g.func = d.func WHERE d.node <> 0
  AND NOT EXISTS (SELECT 1 FROM t JOIN {pv_write} x ON x.func = t.func AND x.boundary = t.dst WHERE t.func = g.func AND t.src = d.node AND x.gvar = g.gvar)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.func = d.func AND t.src = d.node AND t.dst = d.node))
SELECT c.func, c.gvar, arg_min(c.node, c.depth * 100 + c.node) AS publication FROM c GROUP BY c.func, c.gvar""",
    True,
)
def gr16_publication_point(v, scratch):
    """For each function and global, the earliest acyclic boundary on the dominator chains after
    which the global is quiet."""
    cfg, writes = scratch.save(v("pv_cfg"), "cfg"), scratch.save(v("pv_write"), "writes")
    dom = scratch.save(graph.dominators(cfg, scratch), "dominators")
    depth = dom.groupBy("func", "node").agg(F.count("*").alias("depth")).where("node <> 0")
    cyclic = scratch.save(graph.on_cycles(cfg, scratch), "cyclic")
    busy = graph.may_write_after(cfg, writes, scratch).withColumnRenamed("boundary", "node")
    quiet = writes.select("func", "gvar").distinct().join(depth, "func").join(busy, ["func", "node", "gvar"], "left_anti").join(cyclic, ["func", "node"], "left_anti")
    return quiet.groupBy("func", "gvar").agg(F.min(F.struct("depth", "node"))["node"].alias("publication"))


@query(
    """, b(origin, node, depth) AS (SELECT fid, fid, CAST(0 AS BIGINT) FROM {pv_func} UNION SELECT b.origin, c.dst, b.depth + 1 FROM b JOIN {pv_call} c ON b.node = c.src WHERE b.depth < 100)
, m AS (SELECT origin, node, min(depth) AS depth FROM b WHERE depth > 0 GROUP BY 1, 2)
, z AS (SELECT origin, node, depth FROM m UNION ALL SELECT fid, fid, 0 FROM {pv_func})
SELECT m.origin, m.node, m.depth, min(c.src) AS parent FROM m JOIN {pv_call} c ON c.dst = m.node JOIN z p ON p.origin = m.origin AND p.node = c.src AND p.depth = m.depth - 1
JOIN {pv_func} f ON f.fid = m.node WHERE f.exported GROUP BY 1, 2, 3""",
    True,
)
def gr18_reentrancy_paths(v, scratch):
    """Shortest call paths from accessors to functions that re-enter, with a parent as witness."""
    start = v("pv_func").select(F.col("fid").alias("origin"), F.col("fid").alias("node"))
    goal = v("pv_func").where("exported").select(F.col("fid").alias("node"))
    return graph.shortest_witness(v("pv_call"), start, goal, scratch)


@query(
    CLOSURE
    + """, reach AS (SELECT src AS func, dst AS callee FROM t UNION SELECT DISTINCT func, func FROM {pv_modref})
SELECT r.func, m.gvar, m.access, min(m.witness) AS witness FROM reach r JOIN {pv_modref} m ON r.callee = m.func GROUP BY 1, 2, 3""",
    True,
)
def modref_transitive(v, scratch):
    """Which globals each function may read or write, itself or through its callees (GR12, AG3)."""
    facts = v("pv_modref").select("func", F.concat_ws(":", F.col("gvar").cast("string"), "access").alias("fact"), "witness")
    found = transitive(v("pv_call").select("src", "dst"), facts, scratch)
    part = F.split("fact", ":")
    return found.select("func", part[0].cast("long").alias("gvar"), part[1].alias("access"), "witness")


# ---- points-to

PTS = """, n AS (SELECT 6 * (count(*) // 3) AS n FROM customer),
e AS (SELECT kind, src, dst, off FROM {pv_edge} WHERE kind <> 'memcpy'
  UNION SELECT 'load', src, 1000000000000000 + src * 1000000000 + dst, NULL FROM {pv_edge} WHERE kind = 'memcpy'
  UNION SELECT 'store', 1000000000000000 + src * 1000000000 + dst, dst, NULL FROM {pv_edge} WHERE kind = 'memcpy'),
t(tag, a, b) USING KEY (tag, a, b) AS (
  SELECT 0, dst, src * SCALE FROM e WHERE kind = 'addr_of' UNION SELECT 1, src, dst FROM e WHERE kind IN (COPIES)
  UNION (
    SELECT 0, c.b, p.b FROM t p JOIN recurring.t c ON p.a = c.a WHERE p.tag = 0 AND c.tag = 1
    UNION SELECT 0, c.b, p.b FROM recurring.t p JOIN t c ON p.a = c.a WHERE p.tag = 0 AND c.tag = 1
    UNION SELECT 1, p.b, e.dst FROM t p JOIN e ON e.kind = 'load' AND e.src = p.a WHERE p.tag = 0 AND p.b <> e.dst
    UNION SELECT 1, e.src, p.b FROM t p JOIN e ON e.kind = 'store' AND e.dst = p.a WHERE p.tag = 0 AND p.b <> e.src
    MORE))"""
INSENSITIVE = PTS.replace("SCALE", "1").replace("COPIES", "'assign', 'gep'")
#: Copies over cells: tag 2 is a cell that holds or is pointed at, of its root; a copy's hub is numbered from 2**50 / 4096 on.
MOVED = "CASE WHEN {x} % 4096 <> 4095 AND {low} % 4096 <> 4095 AND {x} % 4096 {sign} {low} % 4096 BETWEEN 0 AND 64 THEN {x} % 4096 {sign} {low} % 4096 ELSE 4095 END"
INTO, OUT = MOVED.format(x="c.a", low="p.b", sign="-"), MOVED.format(x="c.a", low="p.b", sign="+")
INSIDE = "(c.a % 4096 = 4095 OR p.b % 4096 = 4095 OR c.a % 4096 >= p.b % 4096 AND (m.size IS NULL OR c.a % 4096 < p.b % 4096 + m.size))"
FIELDS = "UNION SELECT 0, e.dst, CASE WHEN p.b % 4096 <> 4095 AND p.b % 4096 + e.off BETWEEN 0 AND 64 THEN p.b + e.off ELSE p.b // 4096 * 4096 + 4095 END FROM t p JOIN e ON e.kind = 'gep' AND e.src = p.a WHERE p.tag = 0"
FIELDS += " UNION SELECT 2, p.b, p.b // 4096 FROM t p WHERE p.tag = 0 UNION SELECT 2, p.a, p.a // 4096 FROM t p WHERE p.tag = 0 AND p.a >= 4096000000000"
for _new, _old in (("t", "recurring.t"), ("recurring.t", "t")):
    FIELDS += f"""
    UNION SELECT 1, c.a, m.hub * 4096 + {INTO} FROM {_new} p JOIN m ON p.a = m.src JOIN {_old} c ON c.tag = 2 AND c.b = p.b // 4096 WHERE p.tag = 0 AND {INSIDE}
    UNION SELECT 1, c.a, p.b // 4096 * 4096 + {OUT} FROM {_new} p JOIN m ON p.a = m.dst JOIN {_old} c ON c.tag = 2 AND c.b = m.hub WHERE p.tag = 0
    UNION SELECT 1, p.a, q.a FROM {_new} p JOIN {_old} q ON p.b = q.b WHERE p.tag = 2 AND q.tag = 2 AND p.a <> q.a AND (p.a % 4096 = 4095 OR q.a % 4096 = 4095) AND p.b < 274877906944"""
SENSITIVE = PTS.replace("SCALE", "4096").replace("COPIES", "'assign'").replace("MORE", FIELDS)
SENSITIVE = SENSITIVE[: SENSITIVE.index("\n  UNION SELECT 'load'")] + "),\nm AS (SELECT src, dst, size, 274877906944 + row_number() OVER () AS hub FROM (SELECT DISTINCT src, dst, CASE WHEN width < 8 THEN 8 * width END AS size FROM {pv_edge} WHERE kind = 'memcpy') c)" + SENSITIVE[SENSITIVE.index(",\nt(tag") :]
#: The insensitive solution beside another, under names of its own.
OTHER = INSENSITIVE.replace("MORE", "").split(",\n", 1)[1].replace("t(tag", "u(tag").replace("recurring.t ", "recurring.u ").replace("FROM t ", "FROM u ").replace("JOIN t ", "JOIN u ")
OTHER = ", " + re.sub(r"\be\b", "g", OTHER)
#: Whether an indirect call's signature fits a function's (PR1), in SQL.
FITS = "i.cc = f.cc AND (i.ret = f.ret OR i.ret = 'V' OR f.ret = 'V') AND starts_with(i.params, f.params)"
JOINT = INSENSITIVE.replace(
    "MORE",
    f"""UNION SELECT 2, i.site, f.fid FROM t p JOIN {{pv_icall}} i ON i.operand = p.a JOIN {{pv_func}} f ON f.address_taken AND f.fid = p.b - 1000000000 AND {FITS} WHERE p.tag = 0
    UNION SELECT 1, (c.a * 17 + k) % n.n, (c.b * 3 + k * 7) % n.n FROM t c, n, range(0, 2) r(k) WHERE c.tag = 2""",
)


def _edges(v, scratch):
    """Constraint edges, some twice; a copy's length is 8 times its width, and unknown from the width 8 on."""
    size = F.when((F.col("kind") == "memcpy") & (F.col("width") < 8), 8 * F.col("width"))
    return scratch.save(v("pv_edge").select("kind", "src", "dst", F.coalesce("off", size).alias("off")), "view-edges")


def _calls(v, scratch):
    """Sites, functions with their objects, and the copies that a call of one from the other makes."""
    n = 6 * (v("customer").count() // 3)
    sites = scratch.save(v("pv_icall").select("site", "operand", "cc", "ret", "params"), "sites")
    functions = v("pv_func").where("address_taken").select((F.col("fid") + OBJECT).alias("obj"), "fid", "cc", "ret", "params")
    functions = scratch.save(functions, "functions")
    return sites, functions, n


class Bindings:
    """What a (site, function) pair copies, computed for the pairs that occur."""

    def __init__(self, n: int):
        self.n = n

    def of(self, hit: DataFrame) -> DataFrame:
        each = hit.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        return each.select(((F.col("site") * 17 + F.col("k")) % self.n).alias("src"), ((F.col("fid") * 3 + F.col("k") * 7) % self.n).alias("dst"))


@query(INSENSITIVE.replace("MORE", "") + " SELECT a AS node, b AS obj FROM t WHERE tag = 0 AND a < 1000000000000000", True)
def gr5_andersen(v, scratch):
    """Inclusion-based points-to facts, fields apart left aside."""
    return points_to.solve_inclusion(_edges(v, scratch), scratch)[0]


@query(SENSITIVE + " SELECT a AS node, b // 4096 AS obj, b % 4096 AS off FROM t WHERE tag = 0 AND a < 1125899906842624", True)
def gr5_andersen_fields(v, scratch):
    """Inclusion-based points-to facts over cells (object, offset); offset 4095 is unknown."""
    pts = points_to.solve_inclusion(_edges(v, scratch), scratch, fields=True)[0]
    return pts.select("node", F.floor(F.col("obj") / 4096).cast("long").alias("obj"), (F.col("obj") % 4096).alias("off"))


@query(JOINT + " SELECT a AS site, b AS fid FROM t WHERE tag = 2", True)
def gr6_joint_call_graph(v, scratch):
    """Targets of indirect calls, found together with the points-to facts that they change."""
    sites, functions, n = _calls(v, scratch)
    return points_to.solve_inclusion(_edges(v, scratch), scratch, calls=(sites, functions, Bindings(n).of))[1]


@query(
    """, m AS (SELECT kind, src, dst FROM {pv_edge}), n AS (SELECT src AS n FROM m UNION SELECT dst FROM m),
q(a, b) AS (SELECT src * 4, dst * 4 FROM m WHERE kind IN ('assign', 'gep') UNION SELECT src * 4, dst * 4 + 1 FROM m WHERE kind = 'addr_of'
  UNION SELECT src * 4 + 2, dst * 4 + 1 FROM m WHERE kind = 'load' UNION SELECT src * 4 + 1, dst * 4 + 2 FROM m WHERE kind = 'store'
  UNION SELECT src * 4 + 2, dst * 4 + 2 FROM m WHERE kind = 'memcpy'),
s AS (SELECT a, b FROM q UNION SELECT b, a FROM q),
l(t, c) USING KEY (t) AS (SELECT n * 4 + k, n * 4 + k FROM n, range(0, 3) r(k) UNION
  SELECT t, min(c) FROM (
    SELECT s.b AS t, x.c FROM recurring.l x JOIN s ON s.a = x.t
    UNION ALL SELECT x.t + 1, y.c FROM recurring.l x JOIN (SELECT w.c AS k, min(z.c) AS c FROM recurring.l w JOIN recurring.l z ON z.t = w.t + 1 WHERE w.t % 4 < 2 GROUP BY w.c) y ON x.c = y.k WHERE x.t % 4 < 2
  ) g JOIN (SELECT t AS ot, c AS oc FROM recurring.l) o ON g.t = o.ot WHERE g.c < o.oc GROUP BY t)
SELECT a.t // 4 AS node, a.c AS class, b.c AS star FROM l a JOIN l b ON b.t = a.t + 1 WHERE a.t % 4 = 0""",
    True,
)
def gr4_steensgaard(v, scratch):
    """Unification classes of values and objects, and the classes that they point at."""
    return points_to.solve_unification(_edges(v, scratch), scratch)


@query(
    INSENSITIVE.replace("MORE", "")
    + """, s AS (SELECT i.site, f.fid FROM t JOIN {pv_icall} i ON i.operand = t.a JOIN {pv_func} f ON f.address_taken AND f.fid = t.b - 1000000000 AND """
    + FITS
    + """ WHERE tag = 0)
SELECT i.site, count(s.fid) AS targets, count(s.fid) = 0 AS unknown FROM {pv_icall} i LEFT JOIN s ON i.site = s.site GROUP BY i.site""",
    True,
)
def d2_icall_resolution(v, scratch):
    """Targets per indirect call; a site without one is unknown, never empty."""
    pts = points_to.solve_inclusion(_edges(v, scratch), scratch)[0]
    sites, functions, _ = _calls(v, scratch)
    f = functions.select("obj", "fid", F.col("cc").alias("fcc"), F.col("ret").alias("fret"), F.col("params").alias("fparams"))
    hit = pts.withColumnRenamed("node", "operand").join(sites, "operand").join(f, "obj").where((F.col("cc") == F.col("fcc")) & P.signatures_fit("ret", "params", "fret", "fparams"))
    per = hit.groupBy("site").agg(F.countDistinct("fid").alias("targets"))
    return sites.join(per, "site", "left").select("site", F.coalesce("targets", F.lit(0)).alias("targets"), F.col("targets").isNull().alias("unknown"))


@query(
    INSENSITIVE.replace("MORE", "")
    + """, g AS (SELECT a, b - 1000000000 AS g FROM t WHERE tag = 0 AND a < 1000000000)
SELECT a AS node, CAST(sum(CASE WHEN g % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS globals, bool_or(g % 5 = 0) AS reaches_function FROM g GROUP BY a""",
    True,
)
def d6_node_resolution(v, scratch):
    """What each value points at: how many globals, and whether a function."""
    pts = points_to.solve_inclusion(_edges(v, scratch), scratch)[0].where(F.col("node") < OBJECT)
    number = F.col("obj") - OBJECT
    return pts.groupBy("node").agg(F.sum(F.when(number % 5 != 0, 1).otherwise(0)).cast("long").alias("globals"), F.bool_or(number % 5 == 0).alias("reaches_function"))


@query(
    INSENSITIVE.replace("MORE", "")
    + """, a AS (SELECT dst AS addr, 'mod' AS access FROM {pv_edge} WHERE kind IN ('store', 'memcpy') UNION SELECT src, 'ref' FROM {pv_edge} WHERE kind IN ('load', 'memcpy')),
p AS (SELECT a.addr, a.access, t.b - 1000000000 AS gvar FROM a JOIN t ON t.tag = 0 AND t.a = a.addr WHERE (t.b - 1000000000) % 5 <> 0),
c AS (SELECT addr, access, count(*) AS n FROM p GROUP BY 1, 2)
SELECT a.addr, a.access, coalesce(CASE WHEN c.n <= 16 THEN p.gvar END, -1) AS gvar, CASE WHEN c.n IS NULL THEN 'unknown' WHEN c.n > 16 THEN 'collapsed' ELSE 'aliased' END AS via, coalesce(c.n, 0) AS candidates
FROM a LEFT JOIN c USING (addr, access) LEFT JOIN p ON p.addr = a.addr AND p.access = a.access AND c.n <= 16""",
    True,
)
def d8_pointer_modref(v, scratch):
    """Globals read or written through pointers; more than 16 collapse to one unknown row (D8, J6, AG6)."""
    edges = _edges(v, scratch)
    pts = scratch.save(points_to.solve_inclusion(edges, scratch)[0], "pts")
    sites = edges.where("kind in ('store', 'memcpy')").select(F.col("dst").alias("addr"), F.lit("mod").alias("access")).union(edges.where("kind in ('load', 'memcpy')").select("src", F.lit("ref"))).distinct()
    sites = scratch.save(sites, "sites")
    at = pts.select(F.col("node").alias("addr"), (F.col("obj") - OBJECT).alias("gvar")).where("gvar % 5 <> 0")
    n = at.groupBy("addr").agg(F.count("*").alias("candidates"))
    few = at.join(n.where("candidates <= 16"), "addr", "left_semi")
    via = F.when(F.col("candidates").isNull(), "unknown").when(F.col("candidates") > 16, "collapsed").otherwise("aliased")
    return sites.join(n, "addr", "left").join(few, "addr", "left").select("addr", "access", F.coalesce("gvar", F.lit(-1)).alias("gvar"), via.alias("via"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(
    SENSITIVE
    + OTHER
    + " SELECT 'fields' AS stage, count(*) AS facts, CAST(0 AS BIGINT) AS violations FROM (SELECT DISTINCT a, b // 4096 FROM t WHERE tag = 0 AND a < 1000000000) UNION ALL SELECT 'inclusion', count(*), 0 FROM u WHERE tag = 0 AND a < 1000000000",
    True,
)
def x1_narrowing_ledger(v, scratch):
    """Each stage's facts must be among those of the coarser one: facts and violations by stage."""
    edges = _edges(v, scratch)
    fine = scratch.save(points_to.solve_inclusion(edges, scratch, fields=True)[0].where(F.col("node") < OBJECT).select("node", F.floor(F.col("obj") / 4096).cast("long").alias("obj")).distinct(), "fine")
    pts = scratch.save(points_to.solve_inclusion(edges, scratch)[0].where(F.col("node") < OBJECT), "pts")
    classes = scratch.save(points_to.solve_unification(edges, scratch), "classes")
    # a fact is among the unification's if the object's class is what the value's points at; no pair of a class is formed
    star, own = classes.select("node", "star"), classes.select(F.col("node").alias("obj"), "class")
    missed = pts.join(star, "node", "left").join(own, "obj", "left").where("star is null or class is null or star <> class")
    row = lambda stage, facts, broken: facts.agg(F.count("*").alias("facts")).crossJoin(broken.agg(F.count("*").alias("violations"))).select(F.lit(stage).alias("stage"), "facts", "violations")
    return row("fields", fine, fine.join(pts, ["node", "obj"], "left_anti")).union(row("inclusion", pts, missed))


#: States (tag 0: mode, entry, node, phase, offset), who asks (1) and what contexts give back (2); no context is over the limit.
WALK = """, n AS (SELECT 6 * (count(*) // 3) AS n FROM customer), k AS (SELECT 1099511627776 AS z), e AS (SELECT DISTINCT kind, src, dst, CASE WHEN kind = 'memcpy' THEN CASE WHEN width < 8 THEN 8 * width END ELSE off END AS off FROM {pv_edge}),
f AS (SELECT src AS node, 0 AS phase, dst AS to_, CASE WHEN kind <> 'gep' THEN 0 ELSE coalesce(-off, z) END AS move FROM e, k WHERE kind IN ('addr_of', 'assign', 'gep')
  UNION SELECT dst, 1, src, CASE WHEN kind <> 'gep' THEN 0 ELSE coalesce(off, z) END FROM e, k WHERE kind IN ('addr_of', 'assign', 'gep')),
x AS (SELECT src AS node, 0 AS phase, 1 AS ask, dst AS at_ FROM e WHERE kind = 'store' UNION SELECT dst, 1, 2, src FROM e WHERE kind = 'load'),
l AS (SELECT 1 AS mode, src AS node, dst AS to_ FROM e WHERE kind = 'load' UNION SELECT 2, dst, src FROM e WHERE kind = 'store'),
y AS (SELECT 1 AS mode, src AS node, dst AS to_, off AS size FROM e WHERE kind = 'memcpy' UNION SELECT 2, dst, src, off FROM e WHERE kind = 'memcpy'),
t(tag, a, b, c, d, e) USING KEY (tag, a, b, c, d, e) AS (
  SELECT DISTINCT CAST(0 AS BIGINT), CAST(0 AS BIGINT), e.src, e.dst, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e JOIN {pv_func} h ON e.kind = 'addr_of' AND h.address_taken AND h.fid = e.src - 1000000000
  UNION (
    SELECT 0, s.a, s.b, f.to_, s.d, CASE WHEN s.a = 0 THEN 0 WHEN s.e = z OR f.move = z OR abs(s.e + f.move) > 64 THEN z ELSE s.e + f.move END FROM t s JOIN f ON f.node = s.c AND f.phase = s.d CROSS JOIN k WHERE s.tag = 0
    UNION SELECT 0, s.a, s.b, s.c, 0, s.e FROM t s WHERE s.tag = 0 AND s.d = 1
    UNION SELECT 0, s.a, s.b, y.to_, 1, s.e FROM t s JOIN y ON y.mode = s.a AND y.node = s.c CROSS JOIN k WHERE s.tag = 0 AND s.d = 0 AND (s.e = z OR s.e BETWEEN 0 AND 64 AND (y.size IS NULL OR s.e < y.size))
    UNION SELECT 1, s.a, s.b, s.d * 4 + x.ask, x.at_, s.e FROM t s JOIN x ON x.node = s.c AND x.phase = s.d WHERE s.tag = 0
    UNION SELECT 0, s.c % 4, s.d, s.d, 1, 0 FROM t s WHERE s.tag = 1
    UNION SELECT 2, s.a, s.b, l.to_, 0, 0 FROM t s JOIN l ON l.mode = s.a AND l.node = s.c CROSS JOIN k WHERE s.tag = 0 AND s.d = 0 AND s.e IN (0, z)
    UNION SELECT 0, w.a, w.b, g.c, w.c // 4, w.e FROM t w JOIN recurring.t g ON g.tag = 2 AND g.a = w.c % 4 AND g.b = w.d WHERE w.tag = 1
    UNION SELECT 0, w.a, w.b, g.c, w.c // 4, w.e FROM recurring.t w JOIN t g ON g.tag = 2 AND g.a = w.c % 4 AND g.b = w.d WHERE w.tag = 1
    MORE))"""


@query(WALK.replace("MORE", "") + " SELECT DISTINCT b AS origin, c AS node, false AS truncated FROM t WHERE tag = 0 AND a = 0", True)
def gr10_callee_walk(v, scratch):
    """Which values a function's address may flow to, on demand, with a stack of offsets (GR9 to GR11)."""
    origins = v("pv_func").where("address_taken").select((F.col("fid") + OBJECT).alias("origin"))
    found, over, _ = points_to.callee_walk(_edges(v, scratch), origins, scratch, limit=None)
    return found.join(over.withColumn("truncated", F.lit(True)), "origin", "left").select("origin", "node", F.coalesce("truncated", F.lit(False)).alias("truncated"))
