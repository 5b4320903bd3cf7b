"""Queries of slices, certificates, proofs and the remaining lowering rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import derive as D
from ..operators import integers, points_to, sinks_of, slices
from .registry import CLOSURE, FITS, INSENSITIVE, QUERIES, SQL, WALK, Bindings, _calls, _edges, query
from .views import OBJECT

PTS = INSENSITIVE.replace("MORE", "")


def _pts(v, scratch):
    return scratch.save(points_to.solve_inclusion(_edges(v, scratch), scratch)[0], "pts")


@query(
    PTS + " SELECT b AS origin, a AS node FROM t WHERE tag = 0 AND a < 1000000000000000 AND (b - 1000000000) % 100 = 0 AND b - 1000000000 IN (SELECT fid FROM {pv_func} WHERE address_taken)",
    True,
)
def gr9_callee_walk_flat(v, scratch):
    """Which nodes a function's address may flow to, on demand and without offsets (GR9)."""
    origins = v("pv_func").where("address_taken and fid % 100 = 0").select((F.col("fid") + OBJECT).alias("origin"))
    return points_to.callee_walk(_edges(v, scratch), origins, scratch, depth=0)[0]


@query(
    """, m AS (SELECT DISTINCT src, dst, coalesce(off, 0) AS off FROM {pv_edge} WHERE kind IN ('assign', 'gep')), t(src, dst) AS (SELECT src, dst FROM m UNION SELECT t.src, m.dst FROM t JOIN m ON t.dst = m.src),
s AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS c FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
i AS (SELECT m.src, m.dst, m.off, x.c FROM m JOIN s x ON x.node = m.src JOIN s y ON y.node = m.dst AND x.c = y.c),
p(n, pot) USING KEY (n) AS (SELECT DISTINCT c, CAST(0 AS BIGINT) FROM i UNION SELECT i.dst, min(p.pot + i.off) FROM p JOIN i ON i.src = p.n WHERE i.dst NOT IN (SELECT n FROM recurring.p) GROUP BY i.dst)
SELECT component, modulus FROM (SELECT i.c AS component, list_reduce(list(abs(a.pot + i.off - b.pot)), lambda x, y: gcd(x, y)) AS modulus FROM i JOIN p a ON a.n = i.src JOIN p b ON b.n = i.dst GROUP BY i.c) WHERE modulus > 0""",
    True,
)
def pag13_cycle_lanes(v, scratch):
    """Strides of cycles that move pointers (PAG13, AG8)."""
    return slices.cycle_lanes(v("pv_edge").where("kind in ('assign', 'gep')").select("src", "dst", "off"), scratch)


@query(
    """, e AS (SELECT DISTINCT src, dst FROM {pv_edge}), b(node, depth) AS (SELECT DISTINCT operand, 0 FROM {pv_icall} UNION SELECT e.src, b.depth + 1 FROM b JOIN e ON e.dst = b.node WHERE b.depth < 60),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node), p AS (SELECT depth, count(*) AS nodes FROM m GROUP BY depth)
SELECT CAST(depth AS BIGINT) AS depth, nodes, CAST(sum(nodes) OVER (ORDER BY depth) AS BIGINT) AS total, sum(nodes) OVER (ORDER BY depth) <= 200000 AS admitted FROM p""",
    True,
)
def gr8_directional_slice(v, scratch):
    """What leads to indirect calls' operands, by distance, within a budget (GR8)."""
    return slices.backward_slice(v("pv_edge"), v("pv_icall").select(F.col("operand").alias("node")), scratch, 200_000)


@query(WALK.replace("MORE", "") + " SELECT DISTINCT b AS origin, c AS node, false AS fallback FROM t WHERE tag = 0 AND a = 0", True)
def gr11_walk_with_fallback(v, scratch):
    """The walk with offsets, where functions over the limit take the solver's answer (GR11)."""
    edges = _edges(v, scratch)
    origins = scratch.save(v("pv_func").where("address_taken").select((F.col("fid") + OBJECT).alias("origin")), "origins")
    found, over, _ = points_to.callee_walk(edges, origins, scratch)
    over = scratch.save(over, "over")
    wide = points_to.solve_inclusion(edges, scratch)[0].select(F.col("obj").alias("origin"), "node").join(over, "origin", "left_semi") if not over.isEmpty() else found.limit(0)
    return found.join(over, "origin", "left_anti").withColumn("fallback", F.lit(False)).union(wide.withColumn("fallback", F.lit(True)))


@query(
    WALK.replace("MORE", f"""UNION SELECT 3, i.site, h.fid, 0, 0, 0 FROM t s JOIN {{pv_icall}} i ON i.operand = s.c JOIN {{pv_func}} h ON h.fid = s.b - 1000000000 AND {FITS.replace("f.", "h.")} WHERE s.tag = 0 AND s.a = 0
    UNION SELECT 4, (c.a * 17 + k) % n.n, (c.b * 3 + k * 7) % n.n, 0, 0, 0 FROM t c, n, range(0, 2) r(k) WHERE c.tag = 3 AND (c.a * 17 + k) % n.n <> (c.b * 3 + k * 7) % n.n
    UNION SELECT 0, s.a, s.b, w.b, 0, s.e FROM t s JOIN recurring.t w ON w.tag = 4 AND w.a = s.c WHERE s.tag = 0 AND s.d = 0 UNION SELECT 0, s.a, s.b, w.b, 0, s.e FROM recurring.t s JOIN t w ON w.tag = 4 AND w.a = s.c WHERE s.tag = 0 AND s.d = 0
    UNION SELECT 0, s.a, s.b, w.a, 1, s.e FROM t s JOIN recurring.t w ON w.tag = 4 AND w.b = s.c WHERE s.tag = 0 AND s.d = 1 UNION SELECT 0, s.a, s.b, w.a, 1, s.e FROM recurring.t s JOIN t w ON w.tag = 4 AND w.b = s.c WHERE s.tag = 0 AND s.d = 1""")
    + " SELECT a AS site, b AS fid FROM t WHERE tag = 3",
    True,
)
def gr10_walk_call_graph(v, scratch):
    """Targets of indirect calls by the walk with offsets, going on through what they bind (GR10)."""
    sites, _, n = _calls(v, scratch)
    functions = scratch.save(v("pv_func").where("address_taken").select((F.col("fid") + OBJECT).alias("obj"), "fid", "cc", "ret", "params"), "functions")
    return points_to.callee_walk(_edges(v, scratch), functions.select(F.col("obj").alias("origin")), scratch, limit=None, calls=(sites, functions, Bindings(n).of))[2]


@query(
    """, o AS (SELECT src AS node, min(dst) AS to_ FROM {pv_call} GROUP BY src HAVING count(*) = 1), s(func, level, callee) AS (SELECT node, 1, to_ FROM o UNION ALL SELECT s.func, s.level + 1, o.to_ FROM s JOIN o ON o.node = s.callee WHERE s.level < 4) SELECT func, level, callee FROM s""",
    True,
)
def gr17_spine_descent(v, scratch):
    """Functions with a single callee, followed down to four levels (GR17)."""
    return slices.spine(v("pv_call"), scratch)


@query(PTS + ", p AS (SELECT a AS node, b AS obj FROM t WHERE tag = 0), w AS (SELECT DISTINCT dst AS node FROM {pv_edge} WHERE kind IN ('store', 'memcpy')) SELECT p.obj - 1000000000 AS object, bool_or(p.node IN (SELECT operand FROM {pv_icall}) OR p.node >= 1000000000) AS exposed, bool_or(p.node IN (SELECT node FROM w)) AS written FROM p WHERE p.node < 1000000000000000 GROUP BY p.obj", True)
def gr19_allocation_isolation(v, scratch):
    """Whether an object's address gets into memory or to a boundary, and whether it is written through (GR19, GR21)."""
    boundary = v("pv_icall").select(F.col("operand").alias("node"), F.lit(True).alias("b")).distinct()
    writes = v("pv_edge").where("kind in ('store', 'memcpy')").select(F.col("dst").alias("node"), F.lit(True).alias("w")).distinct()
    rows = _pts(v, scratch).join(boundary, "node", "left").join(writes, "node", "left")
    exposed = F.coalesce("b", F.lit(False)) | (F.col("node") >= OBJECT)
    return rows.groupBy((F.col("obj") - OBJECT).alias("object")).agg(F.bool_or(exposed).alias("exposed"), F.bool_or(F.coalesce("w", F.lit(False))).alias("written"))


@query(PTS + " SELECT a AS node, CAST(count(*) AS BIGINT) AS count, count(*) > 64 AS incomplete, array_to_string(list_sort(list(b))[1:64], ',') AS origins FROM t WHERE tag = 0 AND a < 1000000000 GROUP BY a", True)
def gr22_allocation_origins(v, scratch):
    """What allocations each value comes from, up to 64 named, with a flag beyond (GR22)."""
    per = D.collapse(_pts(v, scratch).where(F.col("node") < OBJECT), ["node"], "obj", 64, 64)
    return per.select("node", "count", F.col("collapsed").alias("incomplete"), F.col("sample").alias("origins"))


@query(
    """, f AS (SELECT DISTINCT src, dst FROM {pv_edge} WHERE kind IN ('assign', 'gep')), h AS (SELECT dst FROM {pv_edge} WHERE kind = 'load' UNION SELECT src FROM f WHERE src NOT IN (SELECT dst FROM {pv_edge} WHERE kind <> 'store')),
o(node) AS (SELECT dst FROM h UNION SELECT f.dst FROM o JOIN f ON f.src = o.node) SELECT node FROM (SELECT src AS node FROM f UNION SELECT dst FROM f) WHERE node NOT IN (SELECT node FROM o)""",
    True,
)
def gr24_closed_producers(v, scratch):
    """Values all of whose producers are known (GR24)."""
    e = v("pv_edge")
    flows = e.where("kind in ('assign', 'gep')").select("src", "dst").distinct()
    heads = flows.select(F.col("src").alias("node")).join(e.where("kind <> 'store'").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return slices.closed_producers(flows, e.where("kind = 'load'").select(F.col("dst").alias("node")).union(heads), scratch)


KILLS = SQL["d19_kill_rules"]


@query(
    f"SELECT w.gvar, CASE WHEN k.code IS NOT NULL THEN concat('killed_', CAST(k.code AS VARCHAR)) WHEN p.publication IS NULL THEN 'no_publication_point' ELSE 'certified' END AS certificate, count(*) AS functions FROM (SELECT DISTINCT func, gvar FROM ({SQL['gr16_publication_point'].split(', w(func')[0] + ' SELECT func, gvar FROM pv_write'})) w LEFT JOIN ({SQL['gr16_publication_point']}) p ON p.func = w.func AND p.gvar = w.gvar LEFT JOIN ({KILLS}) k ON k.gid = w.gvar GROUP BY 1, 2",
    plain=True,
)
def d20_phase_certificates(v, scratch):
    """Which written globals settle after a point of their function, and what kills that."""
    spark = v("pv_func").sparkSession
    sf = v.sf_dir
    points, kills = QUERIES["gr16_publication_point"](spark, sf), QUERIES["d19_kill_rules"](spark, sf).withColumnRenamed("gid", "gvar")
    rows = v("pv_write").select("func", "gvar").distinct().join(points, ["func", "gvar"], "left").join(kills, "gvar", "left")
    rule = F.when(F.col("code").isNotNull(), F.concat(F.lit("killed_"), F.col("code").cast("string"))).when(F.col("publication").isNull(), "no_publication_point").otherwise("certified")
    return rows.groupBy("gvar", rule.alias("certificate")).agg(F.count("*").alias("functions"))


RANKS = {"undefined": 0, "global_symbol": 1, "other_load": 1, "fn_address": 8}


@query(
    """, w(site, node, d) AS (SELECT site, operand, 0 FROM {pv_icall} UNION SELECT w.site, e.src, w.d + 1 FROM w JOIN {pv_edge} e ON e.dst = w.node AND e.kind IN ('assign', 'gep') WHERE w.d < 40),
l AS (SELECT w.site, CASE WHEN e.kind = 'load' THEN 'other_load' WHEN (e.src - 1000000000) % 5 = 0 THEN 'fn_address' ELSE 'global_symbol' END AS label FROM w JOIN {pv_edge} e ON e.dst = w.node AND e.kind IN ('load', 'addr_of')
  UNION SELECT site, 'undefined' FROM w WHERE node NOT IN (SELECT dst FROM {pv_edge} WHERE kind <> 'store'))
SELECT site, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(CASE label WHEN 'undefined' THEN 0 WHEN 'fn_address' THEN 8 ELSE 1 END) AS bucket FROM l GROUP BY site""",
    True,
)
def d25_operand_census(v, scratch):
    """What produces each indirect call's operand, and the bucket of the least rank."""
    e = scratch.save(v("pv_edge").select("kind", "src", "dst").distinct(), "edges")
    back = e.where("kind in ('assign', 'gep')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    from ..operators.graph import reachable

    walk = reachable(back, v("pv_icall").select(F.col("site").alias("origin"), F.col("operand").alias("node")), scratch)
    ends = e.where("kind in ('load', 'addr_of')").select(F.col("dst").alias("node"), F.when(F.col("kind") == "load", "other_load").when((F.col("src") - OBJECT) % 5 == 0, "fn_address").otherwise("global_symbol").alias("label"))
    bare = walk.join(e.where("kind <> 'store'").select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("origin", F.lit("undefined").alias("label"))
    labels = walk.join(ends, "node").select("origin", "label").union(bare)
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return labels.groupBy(F.col("origin").alias("site")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.min(rank[F.col("label")]).alias("bucket"))


@query("SELECT p_partkey AS gid, NOT regexp_matches(replace(concat(p_type, CASE p_size % 6 WHEN 0 THEN ' %d' WHEN 1 THEN ' %n' WHEN 2 THEN ' %%n' WHEN 3 THEN ' %-08.3lln' WHEN 4 THEN ' %%%n' ELSE ' 100% nothing' END), '%%', ''), '%[-+ #0]*(\\*|[0-9]+)?(\\.(\\*|[0-9]*))?(hh|h|ll|l|j|z|t|L|q)?n') AS safe FROM part", plain=True)
def pag7_format_proof(v, scratch):
    """Formats that provably store nothing through %n (PAG7)."""
    tail = F.element_at(F.array(*map(F.lit, (" %d", " %n", " %%n", " %-08.3lln", " %%%n", " 100% nothing"))), (F.col("p_size") % 6 + 1).cast("int"))
    return v("part").select(F.col("p_partkey").alias("gid"), slices.without_percent_n(F.concat("p_type", tail)).alias("safe"))


@query(CLOSURE + " SELECT fid, NOT external AND fid NOT IN (SELECT t.src FROM t JOIN {pv_func} b ON b.fid = t.dst WHERE b.external AND b.vararg) AS safe FROM {pv_func} WHERE vararg", True)
def pag8_vararg_tails(v, scratch):
    """Variadic functions whose tail only functions of the program read (PAG8)."""
    from ..operators.graph import transitive_closure

    bad = v("pv_func").where("external and vararg").select(F.col("fid").alias("dst"))
    unsafe = transitive_closure(v("pv_call"), scratch).join(bad, "dst").select(F.col("src").alias("fid"), F.lit(True).alias("u")).distinct()
    return v("pv_func").where("vararg").join(unsafe, "fid", "left").select("fid", (~F.col("external") & F.col("u").isNull()).alias("safe"))


@query(
    """, d AS (SELECT func, dest, kind FROM {pv_stmt}) SELECT coalesce(d.kind = 'ptr_to_int', false) AS proven, CASE WHEN coalesce(d.kind = 'ptr_to_int', false) THEN 'none' WHEN starts_with(s.op1, '@') THEN 'symbol' WHEN d.kind IS NULL THEN 'unknown' ELSE d.kind END AS boundary, count(*) AS casts
FROM {pv_stmt} s LEFT JOIN d ON d.func = s.func AND d.dest = s.op1 WHERE s.kind = 'int_to_ptr' GROUP BY 1, 2"""
)
def pag12_integer_origins(v, scratch):
    """Where integers cast to pointers come from, and what stops the proof (PAG12, SRC14)."""
    s = v("pv_stmt")
    made = s.select("func", F.col("dest").alias("op1"), F.col("kind").alias("maker"))
    rows = s.where("kind = 'int_to_ptr'").select("func", "op1").join(made, ["func", "op1"], "left")
    proven = F.coalesce(F.col("maker") == "ptr_to_int", F.lit(False))
    boundary = F.when(proven, "none").when(F.col("op1").startswith("@"), "symbol").when(F.col("maker").isNull(), "unknown").otherwise(F.col("maker"))
    return rows.groupBy(proven.alias("proven"), boundary.alias("boundary")).agg(F.count("*").alias("casts"))


@query("SELECT a.func, a.idx, NOT EXISTS (SELECT 1 FROM {pv_stmt} u WHERE u.func = a.func AND (u.op1 = a.dest OR u.op2 = a.dest) AND u.kind NOT IN ('assign', 'ptr_to_int')) AS innocuous FROM {pv_stmt} a WHERE a.kind = 'ptr_to_int'")
def src13_pointer_to_integer_uses(v, scratch):
    """Casts to integers whose every use is harmless (SRC13)."""
    s = scratch.save(v("pv_stmt"), "stmts")
    used = s.where("kind not in ('assign', 'ptr_to_int')").select("func", F.explode(F.array("op1", "op2")).alias("dest")).where("dest is not null").distinct().withColumn("used", F.lit(True))
    return s.where("kind = 'ptr_to_int'").select("func", "idx", "dest").join(used, ["func", "dest"], "left").select("func", "idx", F.col("used").isNull().alias("innocuous"))


@query("SELECT l_orderkey AS func, l_linenumber AS idx, min(CAST(l_quantity AS BIGINT) * 4) AS byte_off, min(gcd(8 * (1 + l_partkey % 6), 4 * (1 + l_suppkey % 9))) AS modulus, min((CAST(l_quantity AS BIGINT) * 4) % gcd(8 * (1 + l_partkey % 6), 4 * (1 + l_suppkey % 9))) AS residue FROM lineitem GROUP BY 1, 2", plain=True)
def src6_gep_displacement(v, scratch):
    """Constant offsets and the lane of two dynamic strides (SRC6)."""
    lane = P.gcd(8 * (1 + F.col("l_partkey") % 6), 4 * (1 + F.col("l_suppkey") % 9))
    off = F.col("l_quantity").cast("long") * 4
    rows = v("lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("idx"), off.alias("off"), lane.alias("lane"))
    return rows.groupBy("func", "idx").agg(F.min("off").alias("byte_off"), F.min("lane").alias("modulus"), F.min(F.pmod("off", "lane")).alias("residue"))


@query("SELECT p_partkey AS gid, i * 16 + j * 8 AS off, CASE WHEN (p_partkey + i + j) % 5 = 0 THEN 'function' WHEN (p_partkey + i + j) % 3 = 0 THEN 'null' ELSE 'global' END AS entry FROM part, range(0, 4) a(i), range(0, 2) b(j) WHERE i < p_size % 4", plain=True)
def src7_initialisers(v, scratch):
    """Nested static initialisers flattened to a row per leaf with its offset (SRC7)."""
    n = F.col("p_size") % 4
    nested = v("part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("gid"), F.posexplode(F.sequence(F.lit(0), n - 1)).alias("i", "_i")).select("gid", "i", F.posexplode(F.array(F.lit(0), F.lit(1))).alias("j", "_j"))
    at = F.col("gid") + F.col("i") + F.col("j")
    return nested.select("gid", (F.col("i") * 16 + F.col("j") * 8).cast("long").alias("off"), F.when(at % 5 == 0, "function").when(at % 3 == 0, "null").otherwise("global").alias("entry"))


@query(f"SELECT gid, strategy, skipped FROM ({SQL['po1_strategy_cascade']})", plain=True)
def snk5_manifest_pair(v, scratch):
    """A manifest and its ledger, written as one canonical record per global and read back (SNK5)."""
    rows = scratch.save(QUERIES["po1_strategy_cascade"](v("pv_func").sparkSession, v.sf_dir), "cascade")
    return sinks_of.round_trip(rows, scratch, "gid")


@query(
    """, o AS (SELECT DISTINCT dest, op, lhs, rhs, k FROM {pv_int}),
s AS (SELECT lhs AS v, dest, CASE op WHEN 'either' THEN 0 WHEN 'add' THEN k WHEN 'sub' THEN -k END AS m, op FROM o WHERE op <> 'cast' UNION SELECT rhs, dest, CASE op WHEN 'either' THEN 0 END, op FROM o WHERE op IN ('either', 'sum')),
f(v, b, x) AS (SELECT dest, lhs, CAST(0 AS BIGINT) FROM o WHERE op = 'cast' UNION SELECT s.dest, f.b, CASE WHEN abs(f.x + s.m) <= 64 THEN f.x + s.m END FROM f JOIN s ON s.v = f.v WHERE s.op <> 'other'),
l(v) AS (SELECT dest FROM o WHERE op = 'other' AND lhs IN (SELECT v FROM f) OR op = 'sum' AND lhs IN (SELECT v FROM f) AND rhs IN (SELECT v FROM f) UNION SELECT s.dest FROM l JOIN s ON s.v = l.v)
SELECT c.dest, coalesce(f.b, -1) AS base, coalesce(f.x, -9999) AS off, f.b IS NOT NULL AS known FROM (SELECT DISTINCT dest FROM {pv_int} WHERE back) c LEFT JOIN (SELECT * FROM f WHERE v NOT IN (SELECT v FROM l)) f ON f.v = c.dest""",
    True,
)
def pag12_integer_provenance(v, scratch):
    """Integers cast back to pointers: moves of the pointers that they come from, or any (SRC14, PAG12)."""
    ops = scratch.save(v("pv_int"), "ints")
    casts = ops.where("back").select("dest", F.col("dest").alias("value")).distinct()
    return integers.recovered(ops, casts, scratch).select("dest", F.coalesce("base", F.lit(-1)).alias("base"), F.coalesce("off", F.lit(-9999)).alias("off"), "known")
