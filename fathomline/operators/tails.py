"""Whether what a variadic function gets beyond its fixed parameters is only ever read.

A list value is an address of the argument list, a tail value a pointer that was read from one.
Values of all functions that either may be make one graph; a function is safe where none of its
lists leads to a use that is no read.  That is the greatest fixpoint of what callees guarantee,
found from the bad uses backwards, so recursion needs no order and no budget of states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .graph import reachable

#: Operands (1 or 2) by which a statement does more than read: what is stored or stored to, copied,
#: returned, made an integer, called or unknown.
MORE_THAN_READ = {"store": (1, 2), "memcpy": (1, 2), "return": (1,), "ptr_to_int": (1,), "int_to_ptr": (1,), "unknown": (1, 2), "call_indirect": (1, 2)}


def _node(kind: str, value="value", func="func"):
    return F.concat_ws("|", F.lit(kind), F.col(func), F.col(value))


def _both(rows: DataFrame, make) -> DataFrame:
    return make(rows, "list").union(make(rows, "tail"))


def tail_proofs(stmts: DataFrame, args: DataFrame, params: DataFrame, starts: DataFrame, reads: DataFrame, scratch: Scratch) -> DataFrame:
    """(func, safe) for each function of ``starts`` (func, value): where lists are opened, value null if a function opens none.

    ``stmts`` (func, kind, dest, op1, op2, pointer): pointer says whether dest may carry one;
    ``args`` (func, callee, pos, value) of direct calls; ``params`` (func, pos, value), with the
    functions of the program alone; ``reads`` (callee, pos): positions that callees outside only read.

    Safe needs an opened list.  Bad are the uses of ``MORE_THAN_READ``; a list given to a callee that opens one
    itself, or to one outside; a tail value given to one outside that may do more than read;
    what is given beyond a callee's fixed parameters; and a value that may be both a list and a
    tail, of whichever functions.  Nulls are no values.
    """
    stmts, args, starts = scratch.save(stmts, "stmts"), scratch.save(args.where("value is not null and callee is not null"), "args"), scratch.save(starts.distinct(), "starts")
    used = stmts.select("func", "kind", "dest", "pointer", F.explode(F.array("op1", "op2")).alias("value")).where("value is not null and dest is not null")
    moved = used.where("kind in ('assign', 'gep')")
    lists = moved.select(_node("list").alias("src"), _node("list", "dest").alias("dst"))
    loaded = used.where("kind = 'load' and pointer")
    tails = loaded.union(moved.where("pointer")).select(_node("tail").alias("src"), _node("tail", "dest").alias("dst"))
    read = loaded.select(_node("list").alias("src"), _node("tail", "dest").alias("dst"))
    to = params.select(F.col("func").alias("callee"), "pos", F.col("value").alias("param"))
    given = scratch.save(args.join(to, ["callee", "pos"], "left"), "given")
    passed = _both(given.where("param is not null"), lambda d, k: d.select(_node(k).alias("src"), _node(k, "param", "callee").alias("dst")))
    flow = scratch.save(reduce(DataFrame.union, [lists, tails, read, passed]).distinct(), "flow")

    pairs = F.create_map(*[F.lit(x) for k, v in MORE_THAN_READ.items() for x in (k, ",".join(map(str, v)))])
    uses = stmts.select("func", pairs[F.col("kind")].alias("bad"), F.explode(F.array(F.struct(F.lit("1").alias("at"), F.col("op1").alias("value")), F.struct(F.lit("2").alias("at"), F.col("op2").alias("value")))).alias("u"))
    uses = uses.where("u.value is not null and bad is not null").where(F.contains(F.col("bad"), F.col("u.at"))).select("func", F.col("u.value").alias("value"))
    bad = _both(uses, lambda d, k: d.select(_node(k).alias("node")))
    lost = given.where("param is null")
    outside = lost.join(reads, ["callee", "pos"], "left_anti").select(_node("tail").alias("node")).union(lost.select(_node("list").alias("node")))
    opened = starts.where("value is not null").select(F.col("func").alias("callee")).distinct()
    again = given.where("param is not null").join(opened, "callee", "left_semi").select(_node("list").alias("node"))
    roots = scratch.save(starts.where("value is not null").select("func", _node("list").alias("node")), "roots")
    ahead = reachable(flow, roots.select(F.lit(0).alias("origin"), "node"), scratch).select("node", F.substring("node", 1, 4).alias("kind"), F.expr("substr(node, 6)").alias("rest"))
    mixed = ahead.groupBy("rest").agg(F.countDistinct("kind").alias("n")).where("n = 2")
    mixed = _both(mixed, lambda d, k: d.select(F.concat_ws("|", F.lit(k), F.col("rest")).alias("node")))
    bad = reduce(DataFrame.union, [bad, outside, again, mixed]).distinct().join(ahead.select("node"), "node", "left_semi")
    back = flow.join(ahead.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    unsafe = reachable(back, bad.select(F.lit(0).alias("origin"), "node"), scratch).select("node", F.lit(True).alias("unsafe"))
    ends = roots.join(unsafe, "node", "left").groupBy("func").agg(F.max(F.coalesce("unsafe", F.lit(False))).alias("unsafe"))
    return starts.select("func").distinct().join(ends, "func", "left").select("func", F.coalesce(~F.col("unsafe"), F.lit(False)).alias("safe"))
