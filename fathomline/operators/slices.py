"""Slices and certificates of the constraint graph: lanes, budgets, origins, closed producers, format proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import gcd
from ..runtime import Scratch
from .graph import strong_components


def cycle_lanes(moves: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, modulus): the stride of offsets that go round each cycle of moves (src, dst, off).

    Potentials come from a breadth-first tree of each strong component; the greatest
    common divisor of what its edges miss them by does not depend on the tree.
    Components whose cycles add up to nothing have no lane.
    """
    edges = scratch.save(moves.select("src", "dst", F.coalesce("off", F.lit(0)).alias("off")).distinct(), "moves")
    strong = scratch.save(strong_components(edges, scratch).select("node", "component"), "strong")
    name = lambda c, n: strong.select(F.col("node").alias(c), F.col("component").alias(n))
    inner = edges.join(name("src", "c"), "src").join(name("dst", "d"), "dst").where("c = d").select("src", "dst", "off", F.col("c").alias("component"))
    inner = scratch.save(inner, "inner")
    new = seen = scratch.save(inner.select(F.col("component").alias("node"), F.lit(0).cast("long").alias("pot")).distinct(), "potential")
    while not new.isEmpty():
        step = new.join(inner, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min(F.col("pot") + F.col("off")).alias("pot"))
        new = scratch.save(step.select(F.col("to").alias("node"), "pot").join(seen, "node", "left_anti"), "new")
        seen = scratch.grow(seen, new, "potential")
    at = lambda c, n: seen.select(F.col("node").alias(c), F.col("pot").alias(n))
    missed = inner.join(at("src", "p"), "src").join(at("dst", "q"), "dst").select("component", F.abs(F.col("p") + F.col("off") - F.col("q")).alias("m"))
    per = missed.groupBy("component").agg(F.collect_set("m").alias("m"))  # as many as distinct offsets
    return per.select("component", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: gcd(a, x)).alias("modulus")).where("modulus > 0")


def backward_slice(edges: DataFrame, goals: DataFrame, scratch: Scratch, budget: int) -> DataFrame:
    """(depth, nodes, total, admitted): what leads to the goals, by distance, and how far a budget of nodes goes."""
    back = scratch.save(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")).distinct(), "back")
    new = seen = scratch.save(goals.select("node").distinct().withColumn("depth", F.lit(0)), "slice")
    depth = 0
    while not new.isEmpty():
        depth += 1
        found = new.join(back, "node").select(F.col("to").alias("node")).distinct()
        new = scratch.save(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "new")
        seen = scratch.grow(seen, new, "slice")
    per = seen.groupBy("depth").agg(F.count("*").alias("nodes"))  # as many rows as steps
    total = F.sum("nodes").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, 0))
    return per.select(F.col("depth").cast("long").alias("depth"), "nodes", total.alias("total")).withColumn("admitted", F.col("total") <= budget)


def closed_producers(flows: DataFrame, opened: DataFrame, scratch: Scratch) -> DataFrame:
    """(node): nodes that nothing open flows into: the complement of what open nodes reach."""
    steps = scratch.save(flows.select(F.col("src").alias("node"), "dst").distinct(), "flows")
    new = seen = scratch.save(opened.select("node").distinct(), "open")
    while not new.isEmpty():
        found = new.join(steps, "node").select(F.col("dst").alias("node")).distinct()
        new = scratch.save(found.join(seen, "node", "left_anti"), "new")
        seen = scratch.grow(seen, new, "open")
    nodes = steps.select("node").union(steps.select("dst")).distinct()
    return nodes.join(seen, "node", "left_anti")


def spine(calls: DataFrame, scratch: Scratch, levels: int = 4) -> DataFrame:
    """(func, level, callee): the only callee, its only callee and so on, down to ``levels``."""
    only = calls.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"), F.count("*").alias("n")).where("n = 1").select("node", "to")
    only = scratch.save(only, "only")
    level = only.select(F.col("node").alias("func"), F.lit(1).alias("level"), F.col("to").alias("callee"))
    out = level
    for k in range(2, levels + 1):
        level = level.join(only, F.col("callee") == F.col("node")).select("func", F.lit(k).alias("level"), F.col("to").alias("callee"))
        out = out.union(level)
    return out


def without_percent_n(text: Column) -> Column:
    """A printf format holds no %n, whatever its flags, width and length."""
    plain = F.replace(text, F.lit("%%"), F.lit(""))
    return ~plain.rlike(r"%[-+ #0]*(\*|[0-9]+)?(\.(\*|[0-9]*))?(hh|h|ll|l|j|z|t|L|q)?n")
