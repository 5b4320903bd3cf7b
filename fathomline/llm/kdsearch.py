"""Exact top-k inner product search with a KD-tree per shard.

Vectors are packed into shards of bounded size.  A shard's tree splits at medians of
its widest component, and each of its nodes, inner ones as well, has a tight bounding
box.  A query goes down best first: of all nodes that it has met and not opened, it
opens the one whose box allows the largest inner product, and stops once no box can
reach its k-th best score; that score is carried from shard to shard.  Queries of a
block go down together, so that each step is one product per node and not per query.

Queries come in blocks of bounded size.  A task meets a run of shards with a chunk of
blocks, so each vector crosses the network once per chunk and each query once per run.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

SHARD = 4096
LEAF = 128
QUERIES = 1024
#: Shards and blocks of queries that meet in one task, at most.
RUN, CHUNK = 8, 16
#: Sums of products below it are exact in doubles.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def integer_rows(batch: pa.RecordBatch, scale: int):
    """(dim, ids, integer vectors) of the rows that take part, by length."""
    vectors = batch.column("embedding")
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors)
    # an integer beyond doubles' 53 bits cannot occur: components are read as doubles
    flat = np.floor(scale * pc.cast(values, pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    ends = np.cumsum(size)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (size > 0) & (wrong[ends] == wrong[ends - size]) & pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(batch.column("vec_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(size[good]).tolist():
        own = np.flatnonzero(good & (size == dim))
        yield dim, ids[own], flat[(ends[own] - dim)[:, None] + np.arange(dim)]


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A KD-tree over the rows of x: their order, and its nodes (first row, end row, first of
    two children or -1), parents before children."""
    order, nodes = np.arange(len(x)), [[0, len(x), -1]]
    at = 0
    while at < len(nodes):
        lo, hi, _ = nodes[at]
        if hi - lo > leaf:
            own = order[lo:hi]
            part = x[own]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            half = (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(part[:, axis], half)]
            nodes[at][2] = len(nodes)
            nodes += [[lo, lo + half, -1], [lo + half, hi, -1]]
        at += 1
    return order, np.array(nodes, np.int64)


def boxes(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest components of each node's rows; inner nodes have their children's."""
    low, high = np.empty((len(nodes), x.shape[1])), np.empty((len(nodes), x.shape[1]))
    for i in range(len(nodes) - 1, -1, -1):
        a, b, c = nodes[i]
        if c < 0:
            low[i], high[i] = x[a:b].min(0), x[a:b].max(0)
        else:
            low[i], high[i] = np.minimum(low[c], low[c + 1]), np.maximum(high[c], high[c + 1])
    return low, high


def search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, nodes: np.ndarray, box: tuple[np.ndarray, np.ndarray], best: np.ndarray, ids: np.ndarray) -> int:
    """Puts a tree's rows into each query's k best scores and ids, in place; returns how many
    nodes were opened.  Rows of x are in the tree's order."""
    low, high = box
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    reach = np.full((len(q), len(nodes)), -np.inf)  # of nodes met and not opened
    reach[:, 0] = up @ high[0] + down @ low[0]
    open_, opened, k = np.arange(len(q)), 0, best.shape[1]
    while len(open_):
        at = reach[open_].argmax(1)
        bound = reach[open_, at]
        # an equal score may come with a smaller id, so an equal bound is opened
        going = (bound >= best[open_, -1]) & (bound > -np.inf)
        open_, at = open_[going], at[going]
        reach[open_, at] = -np.inf
        for node in np.unique(at).tolist():
            who = open_[at == node]
            opened += 1
            a, b, c = nodes[node].tolist()
            if c >= 0:
                reach[who, c : c + 2] = up[who] @ high[c : c + 2].T + down[who] @ low[c : c + 2].T
                continue
            s = q[who] @ x[a:b].T
            s[qid[who][:, None] == xid[a:b][None, :]] = -np.inf
            _put(who, s, np.broadcast_to(xid[a:b], s.shape), best, ids, k)
    return opened


def _put(who, s, d, best, ids, k):
    s, d = np.concatenate([best[who], s], axis=1), np.concatenate([ids[who], d], axis=1)
    pick = np.lexsort((d, -s), axis=1)[:, :k]
    best[who], ids[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(d, pick, 1)


def _exactly(q, qid, x, xid, k) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best by Python's integers, for products beyond doubles."""
    own, rows = [[int(v) for v in r] for r in x], []
    for a, i in zip(q, qid.tolist(), strict=True):
        a = [int(v) for v in a]
        s = sorted((-sum(map(int.__mul__, a, b)), j) for b, j in zip(own, xid.tolist(), strict=True) if j != i)
        rows += [(i, j, max(-_LONG - 1, min(_LONG, -v))) for v, j in s[:k]]
    return rows


def _answer(shards: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """The k best of each query of some blocks among the rows of some shards."""
    trees = []
    if not shards.num_rows or not blocks.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
    dim = shards.column("dim")[0].as_py()
    matrix = lambda b: np.frombuffer(b, "<f8").reshape(-1, dim)
    for i, data, nodes in zip(*(shards.column(c).to_pylist() for c in ("ids", "data", "nodes")), strict=True):
        x, n = matrix(data), np.frombuffer(nodes, "<i8").reshape(-1, 3)
        trees.append((x, np.frombuffer(i, "<i8"), n, boxes(x, n)))
    most = np.max([np.maximum(np.abs(low[0]), np.abs(high[0])) for *_, (low, high) in trees], axis=0)
    out = [[], [], []]
    for i, data in zip(*(blocks.column(c).to_pylist() for c in ("qids", "qdata")), strict=True):
        qid, q = np.frombuffer(i, "<i8"), matrix(data)
        if np.abs(q).max(0) @ most >= EXACT:
            x, xid = np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees])
            for to, own in zip(out, zip(*_exactly(q, qid, x, xid, k), strict=True), strict=False):
                to.append(np.array(own, np.int64))
            continue
        best, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for x, xid, nodes, box in trees:
            search(q, qid, x, xid, nodes, box, best, ids)
        real = np.isfinite(best)
        for to, own in zip(out, (np.repeat(qid, k)[real.ravel()], ids[real], best[real].astype(np.int64)), strict=True):
            to.append(own)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=["query_id", "vec_id", "score"])


_PACKED = "dim int, part long, seq long, ids binary, data binary, nodes binary"


def _pack(batches, size: int, scale: int, tree: bool):
    """Rows in blocks of one dimension, numbered within the task."""
    part = TaskContext.get().partitionId()
    held: dict[int, list] = {}
    made: dict[int, int] = {}

    def out(dim, ids, x):
        order, nodes = build(x) if tree else (slice(None), np.zeros(0, np.int64))
        row = (dim, part, made.get(dim, 0), ids[order].astype("<i8").tobytes(), x[order].astype("<f8").tobytes(), nodes.astype("<i8").tobytes())
        made[dim] = made.get(dim, 0) + 1
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    for b in batches:
        for dim, ids, rows in integer_rows(b, scale):
            own = held.setdefault(dim, [])
            own.append((ids, rows))
            while sum(len(i) for i, _ in own) >= size:
                i, x = np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])
                yield out(dim, i[:size], x[:size])
                own[:] = [(i[size:], x[size:])]
    for dim, own in held.items():
        if ids := [i for i, _ in own if len(i)]:
            yield out(dim, np.concatenate(ids), np.concatenate([x for _, x in own]))


def _numbered(packed: DataFrame, name: str, per: int) -> DataFrame:
    """``packed`` with the number of each row's group of ``per`` rows of its dimension, from 0
    without gaps: counts of the tasks before it, and its place in its own."""
    counts = packed.groupBy("dim", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("dim").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("dim", "part", before.alias("before"))
    return packed.join(before, ["dim", "part"]).withColumn(name, F.floor((F.col("before") + F.col("seq")) / per).cast("long")).drop("before", "part", "seq")


def _every(numbered: DataFrame, name: str, other: DataFrame, per: int) -> DataFrame:
    """A row of ``numbered`` for each group of ``per`` rows that ``other`` has in its dimension."""
    groups = other.groupBy("dim").agg(F.ceil(F.count("*") / per).cast("long").alias("groups"))
    return numbered.join(groups, "dim").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` rows of ``vectors``
    with the largest inner products; both have (vec_id long, embedding array).

    Components x, read as doubles, count as floor(scale * x), and scores are exact; one
    beyond 64 bits is cut to the nearest that they hold.  Ties go to the smaller vec_id,
    and of rows that repeat one, each counts.  A row is no answer to a query of its own
    vec_id; of queries that repeat a vec_id, the least vector is asked.  Vectors that are
    null, empty or hold null or non-finite components take no part, and vectors of
    another length than a query's are no answers to it.  Fewer than k candidates give
    fewer rows; no rows give none.  Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "kdsearch")
    plain = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = plain(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    pack = lambda d, size, tree: d.mapInArrow(partial(_pack, size=size, scale=scale, tree=tree), _PACKED)
    shards = scratch.save(pack(plain(vectors), SHARD, True), "shards")
    blocks = scratch.save(pack(asked, QUERIES, False).drop("nodes"), "blocks")
    left = _every(_numbered(shards, "run", RUN), "chunk", blocks, CHUNK)
    right = _every(_numbered(blocks, "q_chunk", CHUNK), "q_run", shards, RUN)
    right = right.select(F.col("dim").alias("q_dim"), "q_run", "q_chunk", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    answer = lambda a, b: _answer(a, b, k)
    found = left.groupBy("dim", "run", "chunk").cogroup(right.groupBy("q_dim", "q_run", "q_chunk")).applyInArrow(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
