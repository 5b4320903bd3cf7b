"""The pointer assignment graph: nodes, edges, call sites and boundary seeds from statements.

Statements are flat rows: func, idx, kind and the operands of the kind.  An operand is a
local value, a symbol (@name) or null; symbols become a node of their own whose address
edge names the object.  Node keys are texts, which dense ids replace at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .derive import union_all
from .graph import near, unseen


def operand(func: str, value: str) -> Column:
    """The node key of an operand; null for the null pointer."""
    v = F.col(value)
    return F.when(v.isNull() | (v == "null"), F.lit(None)).when(v.startswith("@"), F.concat(F.lit("sym:"), v)).otherwise(F.concat(F.lit("val:"), F.col(func), F.lit(":"), v))


def edges(stmts: DataFrame, functions: DataFrame) -> DataFrame:
    """(kind, src, dst, off, owner) from statements and functions (key, external, nparams)."""
    s = stmts
    val = lambda c: operand("func", c)
    none = F.lit(None).cast("long")

    def rows(cond: str, kind: str, src: Column, dst: Column, off: Column = none) -> DataFrame:
        return s.where(cond).select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), off.alias("off"), F.col("func").alias("owner"))

    local = [
        rows("kind = 'alloca'", "addr_of", F.concat_ws(":", F.lit("obj:alloca"), "func", "dest"), val("dest")),
        rows("kind = 'assign'", "assign", val("op1"), val("dest")),
        rows("kind = 'assign' and op2 is not null", "assign", val("op2"), val("dest")),
        rows("kind = 'load'", "load", val("op1"), val("dest")),
        rows("kind = 'store'", "store", val("op1"), val("op2")),
        rows("kind = 'gep'", "gep", val("op1"), val("dest"), F.col("off")),
        rows("kind = 'memcpy'", "memcpy", val("op2"), val("op1")),
        rows("kind = 'return'", "assign", val("op1"), F.concat_ws(":", F.lit("ret"), "func")),
    ]
    known = functions.select(F.col("key").alias("callee"), "external", "nparams")
    calls = s.where("kind = 'call_direct'").join(known, "callee").where("not external")
    args = calls.select("func", "callee", "nparams", F.posexplode(F.array("op1", "op2")).alias("pos", "arg")).where("pos < nparams")
    bound = args.select(F.lit("assign").alias("kind"), operand("func", "arg").alias("src"), F.concat_ws(":", F.lit("param"), "callee", "pos").alias("dst"), none.alias("off"), F.col("func").alias("owner"))
    back = calls.select(F.lit("assign").alias("kind"), F.concat_ws(":", F.lit("ret"), "callee").alias("src"), val("dest").alias("dst"), none.alias("off"), F.col("func").alias("owner"))
    used = union_all([s.select(F.col(c).alias("sym")) for c in ("op1", "op2")]).where("sym like '@%'").distinct()
    kind = F.when(F.col("sym").startswith("@f"), "obj:function:").otherwise("obj:global:")
    named = used.select(F.lit("addr_of").alias("kind"), F.concat(kind, F.ltrim(F.substring("sym", 2, 100))).alias("src"), F.concat(F.lit("sym:"), "sym").alias("dst"), none.alias("off"), F.lit("module").alias("owner"))
    return union_all([*local, bound, back]).where("src is not null and dst is not null").distinct().unionByName(named)


def callsites(stmts: DataFrame) -> DataFrame:
    """(func, site, kind, target): calls with their ordinal in the function."""
    from pyspark.sql import Window as W

    calls = stmts.where("kind in ('call_direct', 'call_indirect')")
    ordinal = F.row_number().over(W.partitionBy("func").orderBy("idx")) - 1
    return calls.select("func", F.concat(F.col("func"), F.lit("@"), "loc", F.lit("#"), ordinal.cast("string")).alias("site"), "kind", F.when(F.col("kind") == "call_direct", F.col("callee")).otherwise(F.col("op1")).alias("target"))


def seeds(stmts: DataFrame, functions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(kind, node): where the unknown enters, as a union of filters.

    A call of an external function without a usable contract is a boundary for its
    arguments and result; with one (exact name and number of parameters) it is not.
    """
    f = functions
    exported = f.where("exported and not external").select(F.lit("exported_symbol").alias("kind"), F.concat(F.lit("obj:function:"), "key").alias("node"))
    imported = f.where("external").select(F.lit("imported_symbol").alias("kind"), F.concat(F.lit("obj:function:"), "key").alias("node"))
    known = F.broadcast(contracts.select("name", "fixed_params", F.lit(True).alias("ok")))
    calls = stmts.where("kind = 'call_direct'").join(f.where("external").select(F.col("key").alias("callee"), "name", "nparams", "vararg"), "callee")
    calls = calls.join(known, (calls.name == known.name) & (calls.nparams == known.fixed_params), "left").where("ok is null")
    external = calls.select(F.when(F.col("vararg"), "vararg_call").otherwise("external_call").alias("kind"), F.explode(F.array(operand("func", "op1"), operand("func", "op2"), operand("func", "dest"))).alias("node"))
    casts = [stmts.where(f"kind = '{k}'").select(F.lit(k).alias("kind"), operand("func", c).alias("node")) for k, c in (("ptr_to_int", "op1"), ("int_to_ptr", "dest"))]
    odd = stmts.where("kind = 'unknown'").select(F.explode(F.array(F.struct(F.lit("unknown_operand").alias("kind"), operand("func", "op1").alias("node")), F.struct(F.lit("unknown_result").alias("kind"), operand("func", "dest").alias("node")))).alias("s")).select("s.*")
    return union_all([exported, imported, external, *casts, odd]).where("node is not null").distinct()


def nodes(edge_table: DataFrame, scratch) -> DataFrame:
    """(id, key, kind): each node once, numbered in the order of keys.

    Numbers are ranks within ranges of keys plus what the ranges before hold.
    """
    from pyspark.sql import Window as W

    keys = edge_table.select(F.col("src").alias("key")).union(edge_table.select("dst")).distinct()
    kind = F.when(F.col("key").startswith("obj:"), F.element_at(F.split("key", ":"), 2)).otherwise(F.element_at(F.split("key", ":"), 1))
    parts = scratch.save(keys.repartitionByRange(16, "key").withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("key")) - 1 + F.col("before")
    return parts.join(F.broadcast(before), "part").select(rank.alias("id"), "key", kind.alias("kind"))


def storage_roots(edge_table: DataFrame, scratch) -> DataFrame:
    """(node, root): values all of whose producers lead to one global or alloca.

    Walks addresses forward over copies and moves; a node with two roots, or with any
    producer that none reaches, has none.
    """
    plain = scratch.save(edge_table.select("kind", "src", "dst"), "root-edges")
    flow = scratch.save(plain.where("kind in ('assign', 'gep')").select(F.col("src").alias("node"), "dst").distinct(), "flow")
    start = plain.where("kind = 'addr_of' and src not like 'obj:function:%'").select(F.col("dst").alias("node"), F.col("src").alias("root")).distinct()
    seen = new = scratch.save(start, "roots")
    count = new.count()
    while count:
        found = near(new, count).join(flow, "node").select(F.col("dst").alias("node"), "root")
        new, count = unseen(found, seen, scratch, "new")
        seen = scratch.grow(seen, new, "roots")
    # what any other producer reaches is open
    heads = flow.select("node").distinct().join(plain.where("kind <> 'store'").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    opened = plain.where("kind in ('load') or kind = 'addr_of' and src like 'obj:function:%'").select(F.col("dst").alias("node")).union(heads).distinct()
    bad = fresh = scratch.save(opened, "open")
    count = fresh.count()
    while count:
        found = near(fresh, count).join(flow, "node").select(F.col("dst").alias("node"))
        fresh, count = unseen(found, bad, scratch, "fresh")
        bad = scratch.grow(bad, fresh, "open")
    one = seen.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n")).where("n = 1")
    return one.join(bad, "node", "left_anti").select("node", "root")


def issues(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """(issue, src, dst): edges that break the graph's rules."""
    kinds = ("addr_of", "assign", "load", "store", "gep", "memcpy")
    object_ = lambda c: F.col(c).startswith("obj:")
    rules = [("unknown_kind", ~F.col("kind").isin(*kinds)), ("address_of_value", (F.col("kind") == "addr_of") & ~object_("src")), ("object_as_value", (F.col("kind") != "addr_of") & (object_("src") | object_("dst"))), ("offset_on_plain", (F.col("kind") != "gep") & F.col("off").isNotNull())]
    found = edge_table.select(F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in rules])).alias("issue"), "src", "dst").where("issue is not null")
    missing = [edge_table.join(node_table.select(F.col("key").alias(c)), c, "left_anti").select(F.lit(f"missing_{c}").alias("issue"), "src", "dst") for c in ("src", "dst")]
    return union_all([found, *missing])
