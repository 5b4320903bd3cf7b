"""Where a global may be published once it is quiet: flow graphs of statements, points on them, and
the same on a function with its only callees put in place of their calls.

A boundary is a run of statements of one source location.  A global is quiet at a boundary
that the entry reaches when nothing may write it afterwards.  A point is a quiet
boundary that source text can be put before, on no cycle, such that each observation of the global
is dominated by it, or dominates it and can be served from the value before publication.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch
from . import graph

ENTRY = -1  # stands before boundary 0, so that functions of one boundary have an edge as well
LEVEL = 1_000_000_000  # boundaries of the callee at level k are numbered from k * LEVEL on
LEVELS = 4


def statement_cfg(stmts: DataFrame, branches: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries (func, boundary, block, first_idx, insertable), steps (func, src, dst) and places
    (func, idx, boundary) of ``stmts`` (func, block, idx, file, line, col) and ``branches`` (func, src, dst) of blocks.

    Boundaries are numbered from 0 in the order of blocks and statements; neighbours without a
    location are one.  Text can be put before a boundary that has a location, whose line no other
    boundary of the function has, and that does not go back from the one before in its block.
    Every block has a statement; branches from or to others, and nulls in ``func``, ``block`` or
    ``idx``, count for nothing.
    """
    loc = F.when(F.col("file").isNotNull(), F.struct("file", "line", "col"))
    rows = stmts.where("func is not null and block is not null and idx is not null").select("func", "block", "idx", loc.alias("loc"))
    order = W.partitionBy("func").orderBy("block", "idx")
    same = (F.col("block") == F.lag("block").over(order)) & F.col("loc").eqNullSafe(F.lag("loc").over(order))
    opens = F.when(same, 0).otherwise(1)
    placed = scratch.save_large(rows.withColumn("opens", opens).withColumn("boundary", F.sum("opens").over(order) - 1).drop("opens"), "placed")
    per = placed.groupBy("func", "boundary").agg(F.min("block").alias("block"), F.min("idx").alias("first_idx"), F.first("loc").alias("loc"))
    inside = W.partitionBy("func", "block").orderBy("boundary")
    before = F.last("loc", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    alone = F.count("*").over(W.partitionBy("func", "loc.file", "loc.line")) == 1
    insertable = F.col("loc").isNotNull() & alone & F.coalesce(F.col("loc") > F.col("before"), F.lit(True))
    bounds = per.withColumn("before", before).select("func", "boundary", "block", "first_idx", insertable.alias("insertable"))
    bounds = scratch.save_large(bounds, "boundaries")
    ends = scratch.save_large(bounds.groupBy("func", "block").agg(F.min("boundary").alias("first"), F.max("boundary").alias("last")), "ends")
    within = bounds.withColumn("dst", F.lead("boundary").over(inside)).where("dst is not null").select("func", F.col("boundary").alias("src"), "dst")
    leave = branches.select("func", F.col("src").alias("block"), F.col("dst").alias("to")).join(ends, ["func", "block"]).select("func", F.col("last").alias("at"), F.col("to").alias("block"))
    across = leave.join(ends, ["func", "block"]).select("func", F.col("at").alias("src"), F.col("first").alias("dst"))
    return bounds, scratch.save_large(within.union(across).distinct(), "steps"), placed.select("func", "idx", "boundary")


def publication_points(steps: DataFrame, nodes: DataFrame, writes: DataFrame, observed: DataFrame, asked: DataFrame, scratch: Scratch, mapped: DataFrame | None = None) -> DataFrame:
    """(func, gvar, outcome, chosen, latest) for ``asked`` (func, gvar), whose functions have a boundary 0.

    ``steps`` (func, src, dst), ``nodes`` (func, node, insertable), ``writes`` (func, node, gvar),
    ``observed`` (func, node, gvar, routable).  ``chosen`` is the first of a dominator chain of
    points and ``latest`` its last.  Without one, the outcome is ``no_entry`` for functions not in
    ``mapped`` (func), by default those with a boundary that text can be put before; ``never_quiet``;
    ``observed_before``, if an observation that cannot be served before publication dominates a
    quiet boundary; or ``no_single_point``, as well for points that are no chain.  An observation
    that the entry does not reach leaves no point.
    """
    nodes, asked = scratch.save_large(nodes.distinct(), "nodes"), scratch.save_large(asked.select("func", "gvar").distinct(), "asked")
    entry = nodes.where("node = 0").select("func", F.lit(ENTRY).cast("long").alias("src"), F.col("node").alias("dst"))
    cfg = scratch.save_large(steps.select("func", "src", "dst").union(entry).distinct(), "flow")
    dom = scratch.save_large(graph.dominators(cfg, scratch, ENTRY).where(f"node <> {ENTRY} and dominator <> {ENTRY}"), "dominators")
    depth = dom.groupBy("func", "node").agg(F.count("*").alias("depth"))
    busy = scratch.save_large(graph.may_write_after(cfg, writes.withColumnRenamed("node", "boundary"), scratch).withColumnRenamed("boundary", "node"), "busy")
    quiet = asked.join(depth, "func").join(busy, ["func", "gvar", "node"], "left_anti").join(nodes, ["func", "node"])
    quiet = scratch.save_large(quiet.select("func", "gvar", "node", "depth", "insertable"), "quiet")
    loops = scratch.save_large(graph.on_cycles(cfg, scratch), "loops")
    fit = scratch.save_large(quiet.where("insertable").join(loops, ["func", "node"], "left_anti").drop("insertable"), "fit")
    seen = observed.select("func", F.col("node").alias("at"), "gvar", "routable").distinct()
    seen = scratch.save_large(seen.join(asked, ["func", "gvar"], "left_semi"), "observed")
    if mapped is None:
        mapped = nodes.where("insertable").select("func").distinct()
    mapped = mapped.withColumn("mapped", F.lit(True)).hint("merge")
    over = dom.select("func", F.col("node").alias("at"), F.col("dominator").alias("node"), F.lit(True).alias("after"))
    under = dom.select("func", F.col("dominator").alias("at"), "node", F.lit(True).alias("earlier"))
    pairs = fit.join(seen, ["func", "gvar"]).join(over, ["func", "at", "node"], "left").join(under, ["func", "at", "node"], "left")
    good = F.coalesce("after", F.lit(False)) | (F.coalesce("earlier", F.lit(False)) & (F.col("at") != F.col("node")) & F.col("routable"))
    valid = fit.join(pairs.where(~good).select("func", "gvar", "node").distinct(), ["func", "gvar", "node"], "left_anti")
    valid = valid.join(mapped, "func", "left_semi")
    chain = W.partitionBy("func", "gvar").orderBy("depth", "node")
    valid = scratch.save_large(valid.withColumn("at", F.lag("node").over(chain)), "valid")
    apart = valid.where("at is not null").join(under, ["func", "at", "node"], "left_anti").select("func", "gvar").distinct()  # equal depths never dominate
    least = F.min(F.struct("depth", "node"))["node"].alias("chosen")
    points = valid.groupBy("func", "gvar").agg(least, F.max(F.struct("depth", "node"))["node"].alias("latest")).join(apart, ["func", "gvar"], "left_anti")
    calm = quiet.select("func", "gvar").distinct().withColumn("calm", F.lit(True))
    none = asked.join(valid.select("func", "gvar"), ["func", "gvar"], "left_anti")
    early = quiet.join(none, ["func", "gvar"], "left_semi").join(seen.where("not routable"), ["func", "gvar"]).join(under, ["func", "at", "node"], "left_semi")
    early = early.select("func", "gvar").distinct().withColumn("early", F.lit(True))
    rows = asked.join(points, ["func", "gvar"], "left").join(calm, ["func", "gvar"], "left").join(early, ["func", "gvar"], "left").join(mapped, "func", "left")
    outcome = F.when(F.col("chosen").isNotNull(), "point").when(F.col("mapped").isNull(), "no_entry").when(F.col("calm").isNull(), "never_quiet").when(F.col("early"), "observed_before").otherwise("no_single_point")
    return scratch.save_large(rows.select("func", "gvar", outcome.alias("outcome"), "chosen", "latest"), "points")


def only_callees(calls: DataFrame, changes: DataFrame, direct: DataFrame, opaque: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(func, gvar, gate, callee): the one boundary of a function by whose only call alone a global is written.

    ``calls`` has one row (func, node, callee) per call, callee null where it is not one known function of
    the program; ``changes`` (func, gvar) written by a function or its callees; ``direct`` (func, node,
    gvar) writes of the function's own; ``opaque`` (func) callees that are external or called from
    unknown places; ``hidden`` (func, gvar) what a function may write through pointers of its own.
    The callee has no other call.
    """
    one = calls.groupBy("func", F.col("node").alias("gate")).agg(F.count("*").alias("n"), F.first("callee").alias("callee")).where("n = 1 and callee is not null")
    sole = calls.where("callee is not null").groupBy("callee").agg(F.count("*").alias("n")).where("n = 1").select("callee")
    sole = sole.join(opaque.select(F.col("func").alias("callee")), "callee", "left_anti")
    rows = one.select("func", "gate", "callee").join(sole, "callee", "left_semi").join(changes.select(F.col("func").alias("callee"), "gvar"), "callee")
    rows = rows.join(direct.select("func", F.col("node").alias("gate"), "gvar").distinct(), ["func", "gate", "gvar"], "left_anti")
    if hidden is not None:
        rows = rows.join(hidden.select("func", "gvar").distinct(), ["func", "gvar"], "left_anti")
    per = rows.groupBy("func", "gvar").agg(F.count("*").alias("n"), F.first("gate").alias("gate"), F.first("callee").alias("callee"))
    return per.where("n = 1").select("func", "gvar", "gate", "callee")


def descended_points(steps: DataFrame, nodes: DataFrame, writes: DataFrame, observed: DataFrame, asked: DataFrame, gates: DataFrame, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """(func, gvar, outcome, depth, at_func, chosen, exhausted): points of functions, and where there is none, of
    functions with their only callee's boundaries in place of its call, and that one's, down to ``levels``.

    The tables are those of ``publication_points``, with what calls write and observe at their
    boundaries, and ``gates`` of ``only_callees``.  The first depth that has a point counts, else the last;
    ``exhausted`` says that a further callee was left.  A gate is no point; it leads to its
    callee's entry, and the callee's ends lead to what followed the gate.  What the call wrote, and
    the observations that can be served early, are the callee's now.  Callees without boundaries
    are no further level.
    """
    steps, nodes = scratch.save_large(steps.distinct(), "steps"), scratch.save_large(nodes.distinct(), "nodes")
    entered = nodes.where("node = 0").select(F.col("func").alias("callee")).distinct()
    gates = scratch.save_large(gates.join(entered, "callee", "left_semi"), "gates")
    writes, observed = scratch.save_large(writes.distinct(), "writes"), scratch.save_large(observed.distinct(), "observed")
    flat = publication_points(steps, nodes, writes, observed, asked, scratch)
    ends = nodes.select("func", "node").join(steps.select("func", F.col("src").alias("node")), ["func", "node"], "left_anti")
    # one row per level of each chain; gate is null on its last
    link = gates.select(F.col("func").alias("leaf"), "gvar", "gate", "callee")
    level = flat.where("outcome <> 'point'").select(F.col("func").alias("root"), "gvar", F.lit(0).alias("level"), F.col("func").alias("leaf"))
    chains, backs, ret = [], [], None
    for k in range(levels + 1):
        level = scratch.save_large(level.join(link, ["leaf", "gvar"], "left").select("root", "gvar", "level", "leaf", "gate", "callee"), "level")
        chains.append(level)
        on = level.where("gate is not null")
        if k == levels or on.isEmpty():
            break
        after = on.join(steps.select(F.col("func").alias("leaf"), F.col("src").alias("gate"), "dst"), ["leaf", "gate"]).select("root", "gvar", (F.col("dst") + k * LEVEL).alias("back"))
        if ret is not None:  # a gate at an end returns where its caller does
            last = on.join(ends.select(F.col("func").alias("leaf"), F.col("node").alias("gate")), ["leaf", "gate"], "left_semi").select("root", "gvar")
            after = after.union(ret.join(last, ["root", "gvar"], "left_semi"))
        ret = scratch.save_large(after, "return")
        backs.append(ret.withColumn("level", F.lit(k)))
        level = on.select("root", "gvar", F.lit(k + 1).alias("level"), F.col("callee").alias("leaf"))
    shallow = flat.select("func", "gvar", "outcome", F.lit(0).alias("depth"), "chosen")
    chain = scratch.save_large(reduce(DataFrame.union, chains), "chains")
    if backs:
        back = reduce(DataFrame.union, backs).hint("merge")
        graphs = chain.where("level > 0").select("root", "gvar", F.col("level").alias("depth"))
        body = graphs.join(chain, ["root", "gvar"]).where("level <= depth").withColumn("gate", F.when(F.col("level") < F.col("depth"), F.col("gate")))
        spine = F.concat_ws(":", F.col("root").cast("string"), F.col("gvar").cast("string"), F.col("depth").cast("string"))
        body = scratch.save_large(body.select(spine.alias("func"), "root", "gvar", "depth", "level", "leaf", "gate"), "spines")
        base = F.col("level").cast("long") * LEVEL
        is_gate = F.col("node").eqNullSafe(F.col("gate"))
        of = lambda t, *keys: body.join(t.withColumnRenamed("func", "leaf"), ["leaf", *keys])
        kept = of(steps).where(~F.col("src").eqNullSafe(F.col("gate"))).select("func", (base + F.col("src")).alias("src"), (base + F.col("dst")).alias("dst"))
        enter = body.where("gate is not null").select("func", (base + F.col("gate")).alias("src"), (base + LEVEL).alias("dst"))
        leave = of(ends).where("level > 0").where(~is_gate).withColumn("level", F.col("level") - 1).withColumn("src", base + LEVEL + F.col("node"))
        leave = leave.join(back, ["root", "gvar", "level"]).select("func", "src", F.col("back").alias("dst"))
        own = (base + F.col("node")).alias("node")
        wide_nodes = of(nodes).select("func", own, (F.col("insertable") & ~is_gate).alias("insertable"))
        wide_writes = of(writes, "gvar").where(~is_gate).select("func", own, "gvar")
        wide_seen = of(observed, "gvar").where(~is_gate | ~F.col("routable")).select("func", own, "gvar", "routable")
        unmapped = body.join(nodes.where("insertable").select(F.col("func").alias("leaf")).distinct(), "leaf", "left_anti").select("func")
        mapped = body.select("func").distinct().join(unmapped, "func", "left_anti")
        deep = publication_points(kept.union(enter).union(leave), wide_nodes, wide_writes, wide_seen, body.select("func", "gvar"), scratch, mapped)
        named = body.select("func", "root", "gvar", "depth").distinct()
        deep = deep.join(named, ["func", "gvar"]).select(F.col("root").alias("func"), "gvar", "outcome", "depth", "chosen")
        shallow = shallow.union(deep)
    ranked = F.struct((F.col("outcome") != "point").alias("none"), F.when(F.col("outcome") == "point", F.col("depth")).otherwise(-F.col("depth")).alias("key"), "outcome", "depth", "chosen")
    best = shallow.groupBy("func", "gvar").agg(F.min(ranked).alias("b")).select("func", "gvar", "b.outcome", "b.depth", "b.chosen")
    at = F.floor(F.col("chosen") / LEVEL).cast("int")
    where = chain.select(F.col("root").alias("func"), "gvar", F.col("level").alias("at"), F.col("leaf").alias("at_func"))
    more = chain.where(f"level = {levels} and gate is not null").select(F.col("root").alias("func"), "gvar", F.lit(True).alias("left"))
    rows = best.withColumn("at", at).join(where, ["func", "gvar", "at"], "left").join(more, ["func", "gvar"], "left")
    here = F.when(F.col("chosen").isNotNull(), F.coalesce("at_func", "func"))
    out = F.coalesce("left", F.lit(False)) & (F.col("outcome") != "point") & (F.col("depth") == levels)
    return rows.select("func", "gvar", "outcome", F.col("depth").cast("long").alias("depth"), here.alias("at_func"), (F.col("chosen") % LEVEL).alias("chosen"), out.alias("exhausted"))
