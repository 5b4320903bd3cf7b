"""Which pointers an integer was made from, and how far it was moved since.

An integer's value is abstracted to (base, offset) pairs: a pointer that was cast to it,
or to an integer that it comes from, and the distance from there, null if unknown.
What may not be undone this way is blocked, and a pointer cast from a blocked integer, or
from one without a base, may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .graph import near, reachable, unseen
from .points_to import MOST_OFFSET

#: Stands for an unknown distance in rounds, whose joins do not match nulls.
LOST = 1 << 62


def integer_provenance(ops: DataFrame, scratch: Scratch, most: int = MOST_OFFSET) -> tuple[DataFrame, DataFrame]:
    """((value, base, off), blocked values) of ``ops`` (dest, op, lhs, rhs, k).

    ``cast`` makes dest of the pointer lhs; ``add`` and ``sub`` move lhs by k, and by an
    unknown distance if k is null; ``mask`` clears low bits of lhs, so it keeps the base but
    not the distance; ``either`` takes lhs or rhs; ``sum`` adds two integers: of one with a
    base and a plain one the base stays, of two with bases nothing is known; ``other`` blocks
    whatever has a base.  What is made of a blocked integer is blocked.  A value that several
    operations make may be any of theirs; one that none makes is a plain integer.  Moves
    beyond ``most`` are unknown, so that integers moved round a cycle settle.
    """
    ops = scratch.held(ops, "ops").select("dest", "op", "lhs", "rhs", "k")
    lhs, rhs = ops.where("op <> 'cast'").select("op", F.col("lhs").alias("value"), "dest", "k"), ops.where("op in ('either', 'sum')").select("op", F.col("rhs").alias("value"), "dest", "k")
    used = lhs.union(rhs).where("value is not null")
    move = F.when(F.col("op") == "either", 0).when(F.col("op") == "add", F.col("k")).when(F.col("op") == "sub", -F.col("k"))
    steps = scratch.save(used.where("op <> 'other'").select("value", "dest", move.cast("long").alias("move")).distinct(), "steps")
    seen = new = scratch.save(ops.where("op = 'cast'").select(F.col("dest").alias("value"), F.col("lhs").alias("base"), F.lit(0).cast("long").alias("off")).distinct(), "facts")
    count = new.count()
    while count:
        at = F.col("off") + F.col("move")
        found = near(new, count).join(steps, "value").select(F.col("dest").alias("value"), "base", F.when(F.abs(at) <= most, at).otherwise(LOST).alias("off"))
        new, count = unseen(found, seen, scratch, "new")
        seen = scratch.grow(seen, new, "facts")
    seen = seen.withColumn("off", F.nullif("off", F.lit(LOST)))
    has = scratch.save(seen.select("value").distinct(), "has")
    of = lambda d, c: d.join(has.withColumnRenamed("value", c), c, "left_semi")
    lost = of(ops.where("op = 'other'"), "lhs").select("dest").union(of(of(ops.where("op = 'sum'"), "lhs"), "rhs").select("dest"))
    lost = lost.distinct().select(F.lit(0).alias("origin"), F.col("dest").alias("node"))
    blocked = reachable(used.select(F.col("value").alias("src"), F.col("dest").alias("dst")), lost, scratch)
    return seen, blocked.select(F.col("node").alias("value"))


def recovered(ops: DataFrame, casts: DataFrame, scratch: Scratch, most: int = MOST_OFFSET) -> DataFrame:
    """(dest, base, off, known) of ``casts`` (dest, value) back to pointers: moves of known bases,
    or one row without a base where the pointer may be any."""
    facts, blocked = integer_provenance(ops, scratch, most)
    whole = facts.join(blocked, "value", "left_anti")
    return casts.join(whole, "value", "left").select("dest", "base", "off", F.col("base").isNotNull().alias("known"))
