"""Queries of flow graphs with branches, of the points where globals may be published, and of variadic tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, phases, tails
from ..sources.contracts import contracts
from .registry import query

FLOW = """, o AS (SELECT *, CASE WHEN block = lag(block) OVER w AND file IS NOT DISTINCT FROM lag(file) OVER w AND line IS NOT DISTINCT FROM lag(line) OVER w THEN 0 ELSE 1 END AS opens
  FROM {pv_flow} WINDOW w AS (PARTITION BY func ORDER BY block, idx)),
p AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY func ORDER BY block, idx) - 1 AS BIGINT) AS boundary FROM o),
r AS (SELECT func, boundary, min(block) AS block, min(idx) AS first_idx, min(file) AS file, min(line) AS line FROM p GROUP BY 1, 2),
b AS (SELECT *, file IS NOT NULL AND count(*) OVER (PARTITION BY func, file, line) = 1 AND coalesce(line > last_value(line IGNORE NULLS) OVER (PARTITION BY func, block ORDER BY boundary ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS insertable FROM r),
n AS (SELECT func, block, min(boundary) AS first, max(boundary) AS last FROM r GROUP BY 1, 2),
e AS (SELECT func, src, dst FROM (SELECT func, boundary AS src, lead(boundary) OVER (PARTITION BY func, block ORDER BY boundary) AS dst FROM r) WHERE dst IS NOT NULL
  UNION SELECT x.func, x.last, y.first FROM {pv_branch} g JOIN n x ON x.func = g.func AND x.block = g.src JOIN n y ON y.func = g.func AND y.block = g.dst)"""

EFFECTS = """, c AS (SELECT func, boundary, idx, callee FROM p WHERE kind = 'call_direct'),
ch(func, gvar, access) AS (SELECT func, gvar, access FROM {pv_touch} WHERE access <> 'pin' UNION SELECT c.func, ch.gvar, ch.access FROM ch JOIN c ON c.callee = ch.func),
ef AS (SELECT p.func, p.boundary AS node, u.gvar, u.access FROM p JOIN {pv_touch} u ON u.func = p.func AND u.idx = p.idx UNION SELECT c.func, c.boundary, ch.gvar, ch.access FROM c JOIN ch ON ch.func = c.callee),
wr AS (SELECT func, node, gvar FROM ef WHERE access = 'mod'), ob AS (SELECT func, node AS at_, gvar, access = 'ref' AS routable FROM ef WHERE access <> 'mod'), q AS (SELECT DISTINCT func, gvar FROM wr)"""

POINTS = """, w(func, node, out_) AS (SELECT func, 0::BIGINT, -1::BIGINT FROM r WHERE boundary = 0 UNION SELECT func, 0, boundary FROM r WHERE boundary > 0
  UNION SELECT w.func, e.dst, w.out_ FROM w JOIN e ON w.func = e.func AND w.node = e.src WHERE e.dst <> w.out_),
live AS (SELECT func, node FROM w WHERE out_ = -1),
dom AS (SELECT l.func, l.node, d.node AS d FROM live l JOIN live d ON l.func = d.func LEFT JOIN w ON w.func = l.func AND w.node = l.node AND w.out_ = d.node AND d.node <> 0 WHERE w.func IS NULL),
dp AS (SELECT func, node, count(*) AS depth FROM dom GROUP BY 1, 2),
t(func, src, dst) AS (SELECT func, src, dst FROM e UNION SELECT t.func, t.src, e.dst FROM t JOIN e ON t.func = e.func AND t.dst = e.src),
busy AS (SELECT DISTINCT t.func, t.src AS node, wr.gvar FROM t JOIN wr ON wr.func = t.func AND wr.node = t.dst),
qt AS (SELECT q.func, q.gvar, dp.node, dp.depth FROM q JOIN dp ON dp.func = q.func ANTI JOIN busy ON busy.func = q.func AND busy.node = dp.node AND busy.gvar = q.gvar),
fit AS (SELECT qt.* FROM qt JOIN b ON b.func = qt.func AND b.boundary = qt.node AND b.insertable ANTI JOIN (SELECT func, src FROM t WHERE src = dst) l ON l.func = qt.func AND l.src = qt.node),
bad AS (SELECT DISTINCT f.func, f.gvar, f.node FROM fit f JOIN ob ON ob.func = f.func AND ob.gvar = f.gvar LEFT JOIN dom x ON x.func = f.func AND x.node = ob.at_ AND x.d = f.node LEFT JOIN dom y ON y.func = f.func AND y.node = f.node AND y.d = ob.at_
  WHERE NOT (x.d IS NOT NULL OR y.d IS NOT NULL AND ob.at_ <> f.node AND ob.routable)),
ok AS (SELECT f.* FROM fit f ANTI JOIN bad ON bad.func = f.func AND bad.gvar = f.gvar AND bad.node = f.node),
split AS (SELECT DISTINCT x.func, x.gvar FROM ok x JOIN ok y ON y.func = x.func AND y.gvar = x.gvar AND x.node < y.node LEFT JOIN dom d ON d.func = x.func AND d.node = y.node AND d.d = x.node LEFT JOIN dom g ON g.func = x.func AND g.node = x.node AND g.d = y.node WHERE d.d IS NULL AND g.d IS NULL),
pt AS (SELECT func, gvar, arg_min(node, depth * 1000000 + node) AS chosen, arg_max(node, depth * 1000000 + node) AS latest FROM ok WHERE (func, gvar) NOT IN (SELECT (func, gvar) FROM split) GROUP BY 1, 2),
early AS (SELECT DISTINCT qt.func, qt.gvar FROM qt JOIN ob ON ob.func = qt.func AND ob.gvar = qt.gvar AND NOT ob.routable JOIN dom ON dom.func = qt.func AND dom.node = qt.node AND dom.d = ob.at_ WHERE (qt.func, qt.gvar) NOT IN (SELECT (func, gvar) FROM ok))
SELECT q.func, q.gvar, CASE WHEN pt.chosen IS NOT NULL THEN 'point' WHEN q.func NOT IN (SELECT func FROM b WHERE insertable) THEN 'no_entry' WHEN (q.func, q.gvar) NOT IN (SELECT (func, gvar) FROM qt) THEN 'never_quiet' WHEN early.func IS NOT NULL THEN 'observed_before' ELSE 'no_single_point' END AS outcome,
  coalesce(pt.chosen, -1) AS chosen, coalesce(pt.latest, -1) AS latest FROM q LEFT JOIN pt ON pt.func = q.func AND pt.gvar = q.gvar LEFT JOIN early ON early.func = q.func AND early.gvar = q.gvar"""


def _flow(v, scratch):
    stmts = scratch.save_large(v("pv_flow").withColumn("col", F.lit(1)), "stmts")
    return stmts, *phases.statement_cfg(stmts, v("pv_branch"), scratch)


def _effects(v, scratch):
    """The tables of points: steps, nodes, writes, observed, asked; calls, changes, direct writes besides."""
    stmts, bounds, steps, places = _flow(v, scratch)
    own = scratch.save_large(v("pv_touch").join(places, ["func", "idx"]).select("func", F.col("boundary").alias("node"), "gvar", "access").distinct(), "own")
    sites = stmts.where("kind in ('call_direct', 'call_indirect')").select("func", "idx", "callee").join(places, ["func", "idx"])
    sites = scratch.save_large(sites.select("func", F.col("boundary").alias("node"), "callee"), "calls")
    up = sites.where("callee is not null").select(F.col("callee").alias("src"), F.col("func").alias("dst")).distinct()
    seeds = own.where("access <> 'pin'").select((F.col("gvar") * 2 + F.when(F.col("access") == "mod", 1).otherwise(0)).alias("origin"), F.col("func").alias("node")).distinct()
    carried = graph.reachable(up, seeds, scratch).select(F.col("node").alias("callee"), F.floor(F.col("origin") / 2).cast("long").alias("gvar"), F.when(F.col("origin") % 2 == 1, "mod").otherwise("ref").alias("access"))
    carried = scratch.save_large(carried, "carried")
    through = sites.join(carried, "callee").select("func", "node", "gvar", "access")
    effects = scratch.save_large(own.union(through).distinct(), "effects")
    writes = effects.where("access = 'mod'").select("func", "node", "gvar")
    observed = effects.where("access <> 'mod'").select("func", "node", "gvar", (F.col("access") == "ref").alias("routable"))
    nodes = bounds.select("func", F.col("boundary").alias("node"), "insertable")
    changes = carried.where("access = 'mod'").select(F.col("callee").alias("func"), "gvar")
    return (steps, nodes, writes, observed, writes.select("func", "gvar").distinct()), sites, changes, own.where("access = 'mod'").select("func", "node", "gvar")


@query(FLOW + " SELECT b.func, b.boundary, b.block, b.first_idx, b.insertable, coalesce(string_agg(CAST(e.dst AS VARCHAR), ',' ORDER BY e.dst), '') AS successors FROM b LEFT JOIN e ON e.func = b.func AND e.src = b.boundary GROUP BY ALL", True)
def src11_branching_cfg(v, scratch):
    """Boundaries of functions with branches, their successors, and which text can be put before (SRC11)."""
    _, bounds, steps, _ = _flow(v, scratch)
    per = steps.groupBy("func", F.col("src").alias("boundary")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("successors"))
    return bounds.join(per, ["func", "boundary"], "left").withColumn("successors", F.coalesce("successors", F.lit("")))


@query(FLOW + EFFECTS + POINTS, True)
def gr16_single_points(v, scratch):
    """Where each global that a function writes may be published in it, on dominator chains, or why nowhere (GR16, D20)."""
    tables, _, _, _ = _effects(v, scratch)
    rows = phases.publication_points(*tables, scratch)
    return rows.select("func", "gvar", "outcome", F.coalesce("chosen", F.lit(-1)).alias("chosen"), F.coalesce("latest", F.lit(-1)).alias("latest"))


@query()
def gr17_descended_points(v, scratch):
    """Points within only callees, put in place of their calls down to four levels (GR17, D20)."""
    tables, sites, changes, direct = _effects(v, scratch)
    unknown = v("pv_func").where("external or address_taken").select(F.col("key").alias("func"))
    gates = phases.only_callees(sites, changes, direct, unknown)
    return phases.descended_points(*tables, gates, scratch)


TAILS = """, u AS (SELECT func, kind, dest, idx % 4 <> 0 AS pointer, unnest([op1, op2]) AS value, unnest([1, 2]) AS at_ FROM {pv_stmt}),
x AS (SELECT a.func, a.callee, a.pos, a.value, f.fid IS NOT NULL AS inside, coalesce(CASE o.name WHEN 'strlen' THEN o.nparams = 1 AND a.pos = 0 WHEN 'memcmp' THEN o.nparams = 3 AND a.pos <= 1 END, false) AS reads
  FROM {pv_arg} a LEFT JOIN {pv_sfunc} f ON f.key = a.callee AND NOT f.external AND a.pos < f.nparams LEFT JOIN {pv_sfunc} o ON o.key = a.callee AND o.external WHERE a.value IS NOT NULL),
fl AS (SELECT func AS f, value AS v, 'list' AS k, func AS g, dest AS d, 'list' AS l FROM u WHERE kind IN ('assign', 'gep') AND value IS NOT NULL
  UNION SELECT func, value, 'tail', func, dest, 'tail' FROM u WHERE kind IN ('assign', 'gep', 'load') AND pointer AND value IS NOT NULL
  UNION SELECT func, value, 'list', func, dest, 'tail' FROM u WHERE kind = 'load' AND pointer AND value IS NOT NULL
  UNION SELECT func, value, k, callee, concat('v', CAST(pos AS VARCHAR)), k FROM x, (VALUES ('list'), ('tail')) q(k) WHERE inside),
ah(f, v, k) AS (SELECT func, value, 'list' FROM {pv_vastart} WHERE value IS NOT NULL UNION SELECT fl.g, fl.d, fl.l FROM ah JOIN fl ON fl.f = ah.f AND fl.v = ah.v AND fl.k = ah.k),
un(f, v, k) AS (SELECT func, value, k FROM u, (VALUES ('list'), ('tail')) q(k) WHERE value IS NOT NULL AND (kind IN ('store', 'memcpy', 'unknown', 'call_indirect') OR at_ = 1 AND kind IN ('return', 'ptr_to_int', 'int_to_ptr'))
  UNION SELECT func, value, k FROM x, (VALUES ('list'), ('tail')) q(k) WHERE NOT inside AND NOT (k = 'tail' AND reads)
  UNION SELECT func, value, 'list' FROM x WHERE inside AND callee IN (SELECT func FROM {pv_vastart} WHERE value IS NOT NULL)
  UNION SELECT f, v, k FROM ah WHERE (f, v) IN (SELECT (f, v) FROM ah GROUP BY f, v HAVING count(*) = 2)
  UNION SELECT fl.f, fl.v, fl.k FROM un JOIN fl ON fl.g = un.f AND fl.d = un.v AND fl.l = un.k)
SELECT func, value IS NOT NULL AND (func, value, 'list') NOT IN (SELECT (f, v, k) FROM un) AS safe FROM {pv_vastart}"""


@query(TAILS, True)
def pag8_tail_proofs(v, scratch):
    """Functions whose opened argument lists are only read, by them and by whom they give them to (PAG8)."""
    stmts = v("pv_stmt").withColumn("pointer", F.col("idx") % 4 != 0)
    functions = v("pv_sfunc")
    inside = functions.where("not external and nparams > 0").select(F.col("key").alias("func"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nparams") - 1)).alias("pos"))
    known = F.broadcast(contracts(functions.sparkSession)).alias("contracts")
    reads = functions.where("external").join(known, "name").where("nparams = fixed_params and result = 'scalar' and policy = 'plain' and not contracts.vararg")
    reads = reads.select(F.col("key").alias("callee"), F.explode(F.array_except("reads", "writes")).alias("pos"))
    params = inside.withColumn("value", F.concat(F.lit("v"), F.col("pos").cast("string")))
    return tails.tail_proofs(stmts, v("pv_arg"), params, v("pv_vastart"), reads, scratch)
