"""Connected components of an undirected graph, by contracting it round by round.

Each vertex moves to that neighbour, or stays, whose hashed number is the least, and on
to where that one moves; edges move with their ends.  What is left shrinks by a constant factor a round (Lacki et
al., 2018), so all rounds together cost little more than the first, and the
rounds needed grow with the logarithm of the graph and not with its diameter.  A round is
one aggregation and three equi-joins over the edges that are left, so no vertex's
neighbourhood has to fit in one task.  The last few edges are joined in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


#: Edges (16 bytes each) that one task may join when no more are left.
SMALL = 100_000
#: Vertices of a component beyond which its name is broadcast: a join would put them all in one task.
MANY = 1 << 17


def _named(at: DataFrame, scratch: Scratch, many: int) -> DataFrame:
    """(vertex, component) of (vertex, to): components with more than ``many`` vertices, few by their size, are broadcast."""
    least = scratch.save(at.groupBy("to").agg(F.min("vertex").alias("component"), F.count("*").alias("n")), "least")
    large = F.broadcast(least.where(F.col("n") > many).select("to", "component"))
    rest = at.join(large, "to", "left_anti").join(least.where(F.col("n") <= many).select("to", "component"), "to")
    return at.join(large, "to").select("vertex", "component").union(rest.select("vertex", "component"))


def _join_all(batches):
    """Union-find over the edges of one task: (vertex, component), by halving paths."""
    u, v = (np.concatenate(x) for x in zip(*[(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches] or [(np.zeros(0, np.int64),) * 2], strict=True))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(names)))  # names ascend, so the least root is the least vertex
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i, r in enumerate(root):
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[np.array(root, np.int64)])], names=["vertex", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, left: str = "src", right: str = "dst", small: int = SMALL, many: int = MANY) -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is its least vertex.

    Null ends, loops and repeated edges are ignored, but a loop still names its
    vertex.  Vertices are longs.  Rounds go on until ``small`` edges or fewer are left,
    which one task joins; with 0, until none is.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    start = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    start = scratch.save(start.distinct(), "pairs")
    if start.count() <= small:
        one = start.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1)
        return scratch.save(one.mapInArrow(_join_all, "vertex long, component long"), "labels")
    now = scratch.save(start.where("u <> v"), "edges")
    moves = []
    while not now.isEmpty():
        if now.count() <= small:
            ends = now.coalesce(1).mapInArrow(_join_all, "vertex long, component long")
            moves.append(scratch.save(ends.select(F.col("vertex").alias("u"), F.col("component").alias("to")), "moves"))
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        around = now.select("u", rank("v").alias("r")).union(now.select("v", rank("u"))).groupBy("u").agg(F.min("r").alias("r"))
        one = scratch.save(around.select("u", F.least("r", rank("u"))["to"].alias("to")), "moves")
        # and on to where that neighbour moves
        to = scratch.save(one.join(one.select(F.col("u").alias("to"), F.col("to").alias("end")), "to").select("u", F.col("end").alias("to")), "moves")
        scratch.drop(one)
        moves.append(to)
        left, right = to.select("u", F.col("to").alias("a")), to.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = now.join(left, "u").join(right, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        before, now = now, scratch.save(moved.distinct(), "edges")
        scratch.drop(before)
    vertices = start.select(F.col("u").alias("vertex")).union(start.select("v")).distinct()
    at = None  # where each vertex of the last round, then of the one before, and so on, ends
    for to in reversed(moves):
        to = to.select(F.col("u").alias("vertex"), "to")
        at = to if at is None else to.join(at.select(F.col("vertex").alias("to"), F.col("to").alias("end")), "to", "left").select("vertex", F.coalesce("end", "to").alias("to"))
    if at is None:
        return scratch.save(vertices.select("vertex", F.col("vertex").alias("component")), "labels")
    at = scratch.save(vertices.join(at, "vertex", "left").select("vertex", F.coalesce("to", "vertex").alias("to")), "ends")
    labels = scratch.save(_named(at, scratch, many), "labels")
    scratch.drop(at, *moves)
    return labels
