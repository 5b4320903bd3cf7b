"""Queries of program files, the pointer assignment graph and the exports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import pag
from ..sources import pir, sinks
from ..sources.contracts import contracts
from .registry import CLOSURE, query

# ---- sources


def _module(v):
    """The view's program as nested documents, 64 modules."""
    sig = F.struct(F.struct(F.lit("integer").alias("class"), F.lit(8).cast("long").alias("size")).alias("ret"), F.transform(F.sequence(F.lit(1), F.col("nparams")), lambda _: F.struct(F.lit("integer").alias("class"), F.lit(8).cast("long").alias("size"))).alias("params"), "vararg", F.lit("ccc").alias("cc"))
    sig = F.when(F.col("nparams") > 0, sig).otherwise(F.struct(F.struct(F.lit("void").alias("class"), F.lit(0).cast("long").alias("size")).alias("ret"), F.array().cast(f"array<{pir.CLASS}>").alias("params"), "vararg", F.lit("ccc").alias("cc")))
    stmt = F.struct("idx", "kind", "dest", F.array("op1", "op2").alias("operands"), F.col("off").alias("byte_off"), "callee", F.col("loc").alias("reason"))
    body = v("pv_stmt").groupBy(F.col("func").alias("key")).agg(F.array_sort(F.collect_list(stmt)).alias("body"))
    f = v("pv_sfunc").join(body, "key", "left").select((F.col("fid") % 64).cast("string").alias("module"), F.struct("key", sig.alias("sig"), "external", "exported", F.coalesce("body", F.array().cast(body.schema["body"].dataType)).alias("body")).alias("f"))
    return f.groupBy("module").agg(F.collect_list("f").alias("functions"))


@query("SELECT func, idx, kind, dest, op1, coalesce(op2, '') AS op2, coalesce(off, -1) AS off, coalesce(callee, '') AS callee FROM {pv_stmt}")
def src1_pir_scan(v, scratch):
    """Modules written as JSON, read with the explicit schema and flattened again (SRC1, PAG1)."""
    path = scratch.path("pir")
    modules = _module(v)
    modules.write.json(path)
    s = pir.statements(pir.read_pir(modules.sparkSession, path))
    return s.select("func", F.col("idx").cast("long").alias("idx"), "kind", "dest", F.col("operands")[0].alias("op1"), F.coalesce(F.col("operands")[1], F.lit("")).alias("op2"), F.coalesce("byte_off", F.lit(-1)).alias("off"), F.coalesce("callee", F.lit("")).alias("callee"))


@query("SELECT kind, count(*) AS statements, CASE kind WHEN 'alloca' THEN 'address' WHEN 'assign' THEN 'copy' WHEN 'return' THEN 'copy' WHEN 'gep' THEN 'move' WHEN 'load' THEN 'memory' WHEN 'store' THEN 'memory' WHEN 'memcpy' THEN 'memory' WHEN 'call_direct' THEN 'call' WHEN 'call_indirect' THEN 'call' ELSE 'boundary' END AS family FROM {pv_stmt} GROUP BY kind")
def src3_statement_kinds(v, scratch):
    """Statements by kind, and the family that lowers them (SRC3)."""
    families = {"alloca": "address", "assign": "copy", "return": "copy", "gep": "move", "load": "memory", "store": "memory", "memcpy": "memory", "call_direct": "call", "call_indirect": "call"}
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return v("pv_stmt").groupBy("kind").agg(F.count("*").alias("statements")).select("kind", "statements", F.coalesce(table[F.col("kind")], F.lit("boundary")).alias("family"))


@query("SELECT s.func, s.idx, CASE WHEN f.external THEN 'external' WHEN f.fid % 10 = 0 THEN 'alias' ELSE 'direct' END AS resolved, CASE WHEN f.fid % 10 = 0 AND NOT f.external THEN concat('f', CAST(f.fid + 1 AS VARCHAR)) ELSE f.name END AS target FROM {pv_stmt} s JOIN {pv_sfunc} f ON f.key = s.callee WHERE s.kind = 'call_direct'")
def src5_call_lowering(v, scratch):
    """Direct calls with aliases resolved and externals named (SRC4, SRC5)."""
    own = v("pv_sfunc").select(F.col("key").alias("callee"), "external", "fid", "name")
    alias = v("pv_sfunc").where("fid % 10 = 0 and not external").select(F.col("key").alias("callee"), F.concat(F.lit("f"), (F.col("fid") + 1).cast("string")).alias("to"))
    rows = v("pv_stmt").where("kind = 'call_direct'").join(own, "callee").join(alias, "callee", "left")
    return rows.select("func", "idx", F.when(F.col("external"), "external").when(F.col("to").isNotNull(), "alias").otherwise("direct").alias("resolved"), F.coalesce("to", "name").alias("target"))


@query("SELECT DISTINCT f.fid FROM {pv_sfunc} f JOIN (SELECT op1 AS op FROM {pv_stmt} WHERE kind <> 'call_direct' AND kind <> 'call_indirect' UNION SELECT op1 FROM {pv_stmt} WHERE kind = 'call_direct') s ON s.op = concat('@', f.key)")
def src8_address_taken(v, scratch):
    """Functions named anywhere but as the callee (SRC8)."""
    used = v("pv_stmt").where("kind <> 'call_indirect'").select(F.col("op1").alias("sym")).where("sym like '@f%'").distinct()
    return v("pv_sfunc").withColumn("sym", F.concat(F.lit("@"), "key")).join(used, "sym", "left_semi").select("fid")


@query("SELECT substr('IVS', CAST(1 + fid % 3 AS INT), 1) AS class, CASE substr('IVS', CAST(1 + fid % 3 AS INT), 1) WHEN 'I' THEN 'pointer' WHEN 'V' THEN 'non_pointer' ELSE 'unknown' END AS value_kind, count(*) AS functions FROM {pv_func} GROUP BY 1, 2")
def src9_abi_classes(v, scratch):
    """ABI class of results and what kind of value they carry (SRC9, SRC10)."""
    kind = F.when(F.col("ret") == "I", "pointer").when(F.col("ret") == "V", "non_pointer").otherwise("unknown")
    return v("pv_func").groupBy(F.col("ret").alias("class"), kind.alias("value_kind")).agg(F.count("*").alias("functions"))


@query("SELECT func, boundary, min(idx) AS first_idx, count(*) AS statements, coalesce(lead(boundary) OVER (PARTITION BY func ORDER BY boundary), -1) AS successor FROM (SELECT func, idx, CAST(sum(opens) OVER (PARTITION BY func ORDER BY idx) AS BIGINT) AS boundary FROM (SELECT func, idx, CASE WHEN loc = lag(loc) OVER (PARTITION BY func ORDER BY idx) THEN 0 ELSE 1 END AS opens FROM {pv_stmt})) GROUP BY func, boundary")
def src11_statement_cfg(v, scratch):
    """Statements of one source location in a row make a boundary; successors follow (SRC11)."""
    w = W.partitionBy("func").orderBy("idx")
    opens = F.when(F.col("loc") == F.lag("loc").over(w), 0).otherwise(1)
    numbered = v("pv_stmt").withColumn("opens", opens).withColumn("boundary", F.sum("opens").over(w))
    per = numbered.groupBy("func", "boundary").agg(F.min("idx").alias("first_idx"), F.count("*").alias("statements"))
    return per.withColumn("successor", F.coalesce(F.lead("boundary").over(W.partitionBy("func").orderBy("boundary")), F.lit(-1)))


@query("SELECT key FROM {pv_func} WHERE exported")
def src16_exports_list(v, scratch):
    """A list of exported symbols with comments and blanks, written and read back (SRC16)."""
    path = scratch.path("exports")
    rows = v("pv_func").select(F.when(F.col("exported"), F.concat(F.lit("@"), "key", F.lit("  # kept"))).when(F.col("fid") % 2 == 0, F.concat(F.lit("# "), "key")).otherwise("").alias("value"))
    rows.write.text(path)
    return pir.read_exports(rows.sparkSession, path)


@query("SELECT concat('f', CAST(caller AS VARCHAR)) AS caller, idx, CASE WHEN target % 7 = 0 THEN '' ELSE concat('f', CAST(target AS VARCHAR)) END AS target FROM {pv_trace}")
def src17_trace_scan(v, scratch):
    """A dynamic trace as tab-separated text, written and read back; ? is unresolved (SRC17)."""
    path = scratch.path("trace")
    name = F.concat(F.lit("f"), F.col("target").cast("string"))
    rows = v("pv_trace").select(F.concat(F.lit("f"), F.col("caller").cast("string")).alias("caller"), "idx", F.when(F.col("target") % 7 == 0, "?").otherwise(name).alias("target"))
    rows.write.option("sep", "\t").csv(path)
    return pir.read_trace(rows.sparkSession, path).select("caller", F.col("idx").cast("long").alias("idx"), F.coalesce("target", F.lit("")).alias("target"))


# ---- graph construction

OPERAND = "CASE WHEN {0} IS NULL OR {0} = 'null' THEN NULL WHEN starts_with({0}, '@') THEN concat('sym:', {0}) ELSE concat('val:', func, ':', {0}) END"
OP1, OP2, DEST, ARG = (OPERAND.replace("{0}", c) for c in ("op1", "op2", "dest", "arg"))
EDGES = f"""SELECT DISTINCT kind, src, dst, coalesce(off, -1) AS off, owner FROM (
  SELECT 'addr_of' AS kind, concat('obj:alloca:', func, ':', dest) AS src, {DEST} AS dst, NULL AS off, func AS owner FROM {{pv_stmt}} WHERE kind = 'alloca'
  UNION ALL SELECT 'assign', {OP1}, {DEST}, NULL, func FROM {{pv_stmt}} WHERE kind = 'assign' UNION ALL SELECT 'assign', {OP2}, {DEST}, NULL, func FROM {{pv_stmt}} WHERE kind = 'assign'
  UNION ALL SELECT 'load', {OP1}, {DEST}, NULL, func FROM {{pv_stmt}} WHERE kind = 'load' UNION ALL SELECT 'store', {OP1}, {OP2}, NULL, func FROM {{pv_stmt}} WHERE kind = 'store'
  UNION ALL SELECT 'gep', {OP1}, {DEST}, off, func FROM {{pv_stmt}} WHERE kind = 'gep' UNION ALL SELECT 'memcpy', {OP2}, {OP1}, NULL, func FROM {{pv_stmt}} WHERE kind = 'memcpy'
  UNION ALL SELECT 'assign', {OP1}, concat('ret:', func), NULL, func FROM {{pv_stmt}} WHERE kind = 'return'
  UNION ALL SELECT 'assign', {ARG}, concat('param:', callee, ':', CAST(pos AS VARCHAR)), NULL, func FROM (SELECT s.func, s.callee, 0 AS pos, s.op1 AS arg, f.nparams FROM {{pv_stmt}} s JOIN {{pv_sfunc}} f ON f.key = s.callee WHERE s.kind = 'call_direct' AND NOT f.external UNION ALL SELECT s.func, s.callee, 1, s.op2, f.nparams FROM {{pv_stmt}} s JOIN {{pv_sfunc}} f ON f.key = s.callee WHERE s.kind = 'call_direct' AND NOT f.external) WHERE pos < nparams
  UNION ALL SELECT 'assign', concat('ret:', callee), {DEST}, NULL, func FROM {{pv_stmt}} s JOIN {{pv_sfunc}} f ON f.key = s.callee WHERE s.kind = 'call_direct' AND NOT f.external
  UNION ALL SELECT 'addr_of', concat(CASE WHEN starts_with(op, '@f') THEN 'obj:function:' ELSE 'obj:global:' END, substr(op, 2)), concat('sym:', op), NULL, 'module' FROM (SELECT op1 AS op FROM {{pv_stmt}} UNION SELECT op2 FROM {{pv_stmt}}) WHERE starts_with(op, '@')
) WHERE src IS NOT NULL AND dst IS NOT NULL"""


def _pag(v, scratch):
    return scratch.save(pag.edges(scratch.save(v("pv_stmt"), "stmts"), v("pv_sfunc")), "edges")


@query(EDGES)
def pag2_edges(v, scratch):
    """All edges of the pointer assignment graph (PAG1, PAG2, PAG4, PAG5)."""
    return _pag(v, scratch).select("kind", "src", "dst", F.coalesce("off", F.lit(-1)).alias("off"), "owner")


@query(f", e AS ({EDGES}) SELECT row_number() OVER (ORDER BY key) - 1 AS id, key, CASE WHEN starts_with(key, 'obj:') THEN split_part(key, ':', 2) ELSE split_part(key, ':', 1) END AS kind FROM (SELECT src AS key FROM e UNION SELECT dst FROM e)")
def pag3_nodes(v, scratch):
    """Each node once, with a dense number in the order of keys (PAG3)."""
    return pag.nodes(_pag(v, scratch), scratch)


@query(f", e AS ({EDGES}) SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY kind")
def pag15_metrics(v, scratch):
    """Edges by kind (PAG15)."""
    return _pag(v, scratch).groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("SELECT func, concat(func, '@', loc, '#', CAST(row_number() OVER (PARTITION BY func ORDER BY idx) - 1 AS VARCHAR)) AS site, kind, coalesce(CASE WHEN kind = 'call_direct' THEN callee ELSE op1 END, '') AS target FROM {pv_stmt} WHERE kind IN ('call_direct', 'call_indirect')")
def pag1_callsites(v, scratch):
    """Call sites with their keys (PAG1)."""
    return pag.callsites(v("pv_stmt")).withColumn("target", F.coalesce("target", F.lit("")))


SEEDS = f"""SELECT DISTINCT kind, node FROM (SELECT 'exported_symbol' AS kind, concat('obj:function:', key) AS node FROM {{pv_sfunc}} WHERE exported AND NOT external UNION ALL SELECT 'imported_symbol', concat('obj:function:', key) FROM {{pv_sfunc}} WHERE external
  UNION ALL SELECT CASE WHEN vararg THEN 'vararg_call' ELSE 'external_call' END, unnest([{OP1}, {OP2}, {DEST}]) FROM {{pv_stmt}} s JOIN {{pv_sfunc}} f ON f.key = s.callee WHERE s.kind = 'call_direct' AND f.external AND NOT (f.name = 'strlen' AND nparams = 1 OR f.name = 'memcmp' AND nparams = 3 OR f.name = 'calloc' AND nparams = 2)
  UNION ALL SELECT 'ptr_to_int', {OP1} FROM {{pv_stmt}} WHERE kind = 'ptr_to_int' UNION ALL SELECT 'int_to_ptr', {DEST} FROM {{pv_stmt}} WHERE kind = 'int_to_ptr'
  UNION ALL SELECT 'unknown_operand', {OP1} FROM {{pv_stmt}} WHERE kind = 'unknown' UNION ALL SELECT 'unknown_result', {DEST} FROM {{pv_stmt}} WHERE kind = 'unknown') WHERE node IS NOT NULL"""


@query(SEEDS)
def pag9_seeds(v, scratch):
    """Where the unknown enters the graph; calls with a contract are no boundary (PAG6, PAG9)."""
    stmts = scratch.save(v("pv_stmt"), "stmts")
    return pag.seeds(stmts, v("pv_sfunc"), contracts(stmts.sparkSession))


@query("SELECT s.func, s.idx, f.name, CASE f.name WHEN 'strlen' THEN '0' WHEN 'memcmp' THEN '0,1' ELSE '' END AS reads, CASE f.name WHEN 'calloc' THEN 'fresh' ELSE 'scalar' END AS result FROM {pv_stmt} s JOIN {pv_sfunc} f ON f.key = s.callee WHERE s.kind = 'call_direct' AND f.external AND (f.name = 'strlen' AND nparams = 1 OR f.name = 'memcmp' AND nparams = 3 OR f.name = 'calloc' AND nparams = 2)")
def pag6_external_contracts(v, scratch):
    """Calls of library functions whose contract fits by exact name and shape (PAG6)."""
    calls = v("pv_stmt").where("kind = 'call_direct'").join(v("pv_sfunc").where("external").select(F.col("key").alias("callee"), "name", "nparams"), "callee")
    known = F.broadcast(contracts(calls.sparkSession))
    return calls.join(known, "name").where("nparams = fixed_params").select("func", "idx", "name", F.array_join(F.transform("reads", lambda x: x.cast("string")), ",").alias("reads"), "result")


@query("SELECT a.func, a.idx AS cast_idx, b.idx AS back_idx FROM {pv_stmt} a JOIN {pv_stmt} b ON a.func = b.func AND a.kind = 'ptr_to_int' AND b.kind = 'int_to_ptr' AND b.op1 = a.dest WHERE NOT EXISTS (SELECT 1 FROM {pv_stmt} u WHERE u.func = a.func AND u.op1 = a.dest AND u.kind NOT IN ('int_to_ptr', 'ptr_to_int'))")
def pag10_round_trips(v, scratch):
    """Pointers cast to integers and back with no other use of the integer (PAG10)."""
    s = scratch.save(v("pv_stmt"), "stmts")
    a = s.where("kind = 'ptr_to_int'").select("func", F.col("idx").alias("cast_idx"), F.col("dest").alias("value"))
    b = s.where("kind = 'int_to_ptr'").select("func", F.col("idx").alias("back_idx"), F.col("op1").alias("value"))
    other = s.where("kind not in ('int_to_ptr', 'ptr_to_int')").select("func", F.col("op1").alias("value"))
    return a.join(b, ["func", "value"]).join(other, ["func", "value"], "left_anti").select("func", "cast_idx", "back_idx")


@query("SELECT func, idx, p AS literal FROM (SELECT func, idx, CASE WHEN idx % 3 = 0 THEN idx * 700 - 3000 ELSE 5000 END AS p FROM {pv_stmt} WHERE kind = 'int_to_ptr') WHERE p > -4096 AND p < 4096")
def pag11_reserved_literals(v, scratch):
    """Integers cast to pointers that no object can lie at (PAG11)."""
    p = F.when(F.col("idx") % 3 == 0, F.col("idx") * 700 - 3000).otherwise(5000)
    return v("pv_stmt").where("kind = 'int_to_ptr'").select("func", "idx", p.alias("literal")).where("literal > -4096 and literal < 4096")


@query(
    f""", e AS ({EDGES}), f AS (SELECT src, dst FROM e WHERE kind IN ('assign', 'gep')),
r(node, root) AS (SELECT dst, src FROM e WHERE kind = 'addr_of' AND NOT starts_with(src, 'obj:function:') UNION SELECT f.dst, r.root FROM r JOIN f ON f.src = r.node),
o(node) AS (SELECT dst FROM e WHERE kind = 'load' OR kind = 'addr_of' AND starts_with(src, 'obj:function:') UNION SELECT src FROM f WHERE src NOT IN (SELECT dst FROM e WHERE kind <> 'store') UNION SELECT f.dst FROM o JOIN f ON f.src = o.node)
SELECT node, min(root) AS root FROM r WHERE node NOT IN (SELECT node FROM o) GROUP BY node HAVING count(*) = 1""",
    True,
)
def pag14_storage_roots(v, scratch):
    """Values that only ever hold addresses within one allocation (PAG14, GR20)."""
    return pag.storage_roots(_pag(v, scratch), scratch)


@query(f", e AS ({EDGES}) SELECT issue, count(*) AS found FROM (SELECT unnest([CASE WHEN kind = 'addr_of' AND NOT starts_with(src, 'obj:') THEN 'address_of_value' END, CASE WHEN off >= 0 AND kind <> 'gep' THEN 'offset_on_plain' END, CASE WHEN kind = 'store' AND src = dst THEN 'object_as_value' END]) AS issue FROM (SELECT CASE WHEN off = 80 THEN 'addr_of' ELSE kind END AS kind, src, dst, off FROM e)) WHERE issue IS NOT NULL AND issue <> 'object_as_value' GROUP BY issue")
def pag16_validation(v, scratch):
    """Broken rules of a graph in which some moves were relabelled as addresses (PAG16)."""
    edges = _pag(v, scratch)
    broken = edges.withColumn("kind", F.when(F.col("off") == 80, "addr_of").otherwise(F.col("kind")))
    return pag.issues(broken, pag.nodes(edges, scratch)).groupBy("issue").agg(F.count("*").alias("found"))


# ---- sinks


@query(CLOSURE + " SELECT src, dst FROM t", True)
def snk1_jsonl_export(v, scratch):
    """A result written as sorted JSON lines and read back (SNK1)."""
    from ..operators import graph

    known = v("pv_func").select(F.col("fid").alias("src"))
    rows = graph.distances(v("pv_call"), scratch).select(F.col("origin").alias("src"), F.col("node").alias("dst")).join(known, "src", "left_semi")
    path = scratch.path("jsonl")
    sinks.write_jsonl(rows, path, ["src", "dst"])
    return sinks.read_back(rows.sparkSession, path, rows.schema)


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN gvar % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM {pv_modref}")
def snk2_export_counts(v, scratch):
    """Record counts of an export, equal by digest before and after it is written (SNK2)."""
    rows = scratch.save(v("pv_modref"), "rows")
    path = scratch.path("export")
    sinks.write_jsonl(rows, path, ["func", "gvar", "access"])
    again = sinks.read_back(rows.sparkSession, path, rows.schema)
    a, b = sinks.content_digest(rows).first(), sinks.content_digest(again).first()
    if a != b:
        raise ValueError(f"the export changed: {a} and {b}")
    return again.agg(F.count("*").alias("n"), F.sum(F.when(F.col("gvar") % 2 == 0, 1).otherwise(0)).alias("even"))


@query("SELECT 'access' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'func_low', count(*) FROM {pv_modref} WHERE NOT func < 1000 UNION ALL SELECT 'witness', count(*) FROM {pv_modref} WHERE NOT witness LIKE '%#0'")
def snk3_schema_validation(v, scratch):
    """Rows against the rules of an export's schema, counted by rule (SNK3)."""
    return sinks.violations(v("pv_modref"), {"access": "access in ('ref', 'mod')", "func_low": "func < 1000", "witness": "witness like '%#0'"})


@query("SELECT concat('extern const char marker_', s, '_', key, '[];') AS line FROM (SELECT key, CASE WHEN is_const THEN 'immutable' WHEN size_bits <= 16 THEN 'atomic' ELSE 'unhandled' END AS s FROM {pv_global}) WHERE s <> 'unhandled'")
def snk6_marker_source(v, scratch):
    """C declarations that mark how each global is handled (SNK6)."""
    s = F.when(F.col("is_const"), "immutable").when(F.col("size_bits") <= 16, "atomic").otherwise("unhandled")
    return sinks.marker_source(v("pv_global").select("key", s.alias("s")), "key", "s")


@query("SELECT func, row_number() OVER (ORDER BY func, idx) - 1 AS id, idx, kind FROM {pv_stmt} WHERE func IN (SELECT key FROM {pv_func} WHERE fid % 37 = 1)")
def snk8_function_dump(v, scratch):
    """Statements of chosen functions with dense numbers of their own (SNK8)."""
    keep = v("pv_func").where("fid % 37 = 1").select(F.col("key").alias("func"))
    rows = v("pv_stmt").join(F.broadcast(keep), "func", "left_semi")
    per = rows.groupBy("func").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("func").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("func").orderBy("idx")) - 1
    return rows.join(per.select("func", before.alias("before")), "func").select("func", (rank + F.col("before")).cast("long").alias("id"), "idx", "kind")
