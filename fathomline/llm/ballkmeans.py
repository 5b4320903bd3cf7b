"""Exact k-means on integer vectors with balls: only neighbours are compared, within annuli.

A cluster is a ball: its centroid, and the largest distance of a member as its radius.
With D the distance of two centroids, a member at distance d of its own can be nearer to
the other (or as near, and then numbered before) only if D <= 2 d.  So a ball's
neighbours are those with D <= 2 r, members with 2 d below the nearest neighbour's D are
its stable core and stay as they are, and the annulus between the n-th and the next
neighbour's D is compared with n neighbours alone.  All tests are on squared integers,
so rounding decides nothing.

Vectors lie in blocks with their clusters.  A round reads them once and writes them
once, with each block's sums, which alone make the new centroids: k rows, which the
driver holds.  In the first round all vectors are in the ball of centroid 0.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

CLUSTERS = 40
ROUNDS = 5
BLOCK = 2048
#: Sums below it are exact in doubles; beyond, Python's integers are used.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_LIMB = 30
_STATE = "n int, dim int, kind string, ids binary, known binary, data binary, cluster binary, far string, distance binary, sums binary"


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: doubles while those are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * values)
    if np.abs(out).max(initial=0) < EXACT:
        return out
    exact = [int(v) * scale if abs(v) >= EXACT else int(np.floor(scale * v)) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _fits(dim: int, *arrays: np.ndarray) -> bool:
    """Whether squared distances between these are exact in doubles."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return dim * (2 * most) ** 2 < EXACT


def _integers(a: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in a.ravel().tolist()], object).reshape(a.shape)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the centroid c, or to its row of c."""
    delta = x - c
    return (delta * delta).sum(1)


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) of each row of x, its squared distance, and how
    many distances were computed.  ``own`` has any cluster of each row, the better the fewer."""
    if not _fits(x.shape[1], x, centroids):
        x, centroids = _integers(x), _integers(centroids)
    between = np.stack([_squares(centroids, c) for c in centroids])
    dist, best = _squares(x, centroids[own]), own.copy()
    near, looked = dist.copy(), len(x)
    for ball in np.unique(own).tolist():
        members = np.flatnonzero(own == ball)
        others = np.flatnonzero(between[ball] <= 4 * dist[members].max())  # the ball's neighbours
        others = others[others != ball]
        others = others[np.argsort(between[ball][others], kind="stable")]
        shells = between[ball][others]
        annulus = np.searchsorted(shells, 4 * dist[members], "right")
        members = members[np.argsort(-annulus, kind="stable")]
        reach = np.sort(annulus)
        for n, other in enumerate(others.tolist()):
            who = members[: len(members) - np.searchsorted(reach, n, "right")]
            if not len(who):
                break
            d = _squares(x[who], centroids[other])
            looked += len(who)
            better = (d < near[who]) | ((d == near[who]) & (other < best[who]))
            near[who[better]], best[who[better]] = d[better], other
    return best, near, looked


def _pack(a: np.ndarray) -> tuple[str, bytes]:
    """An integer array in the least type that holds it, or as digits."""
    if a.dtype != object:
        low, high = int(a.min(initial=0)), int(a.max(initial=0))
        kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        return kind, a.astype(f"<{kind}").tobytes()
    return "digits", ",".join(map(str, a.ravel().tolist())).encode()


def _unpack(kind: str, data: bytes) -> np.ndarray:
    if kind == "digits":
        return np.array([int(v) for v in data.split(b",")], object)
    return np.frombuffer(data, f"<{kind}").astype(np.float64)


def _sums(x: np.ndarray, best: np.ndarray, near: np.ndarray) -> bytes:
    """Lines of cluster, count, summed distance and summed components, of the clusters met."""
    lines = []
    for c in np.unique(best).tolist():
        who = best == c
        parts = x[who]
        # a block has at most BLOCK rows, whose sums are exact in doubles below 2**53
        total = [sum(map(int, col)) for col in parts.T.tolist()] if parts.dtype == object or BLOCK * np.abs(parts).max(initial=0) >= EXACT else parts.sum(0).astype(np.int64).tolist()
        lines.append(" ".join(map(str, (c, int(who.sum()), sum(map(int, near[who].tolist())), *total))))
    return "\n".join(lines).encode()


def _row(dim, kind, ids, known, data, best, near, sums) -> pa.RecordBatch:
    values = (len(best), dim, kind, ids, known, data, best.astype("<i4").tobytes(), *_pack(near), sums)
    types = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4, pa.string(), *[pa.binary()] * 2]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _STATE.split(", ")])


def _blocks(batches, dim: int, scale: int, size: int):
    """Vectors that take part in blocks of one task's rows, all in cluster 0."""
    held: list[tuple] = []

    def out(ids, known, x):
        kind, data = _pack(x)
        zero = np.zeros(len(x))
        return _row(dim, kind, ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), data, zero, zero, b"")

    for batch in batches:
        vectors = batch.column("embedding")
        length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.cast(pc.list_flatten(vectors), pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length)
        wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        good = np.flatnonzero((length == dim) & (wrong[ends] == wrong[ends - length]))
        if not len(good):
            continue
        ids = batch.column("vec_id")
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[good]
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)[good]
        held.append((ids, known, scaled(flat[(ends[good] - dim)[:, None] + np.arange(dim)], scale)))
        while sum(len(i) for i, *_ in held) >= size:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield out(*(c[:size] for c in whole))
            held = [tuple(c[size:] for c in whole)]
    if held and sum(len(i) for i, *_ in held):
        yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _round(batches, centroids: list[list[int]]):
    """The blocks with each vector in its nearest centroid's cluster."""
    for batch in batches:
        for r in batch.to_pylist():
            x = _unpack(r["kind"], r["data"]).reshape(r["n"], r["dim"])
            c = np.array(centroids, object)
            if _fits(r["dim"], c):
                c = c.astype(np.float64)
            best, near, _ = assign(x, np.frombuffer(r["cluster"], "<i4").astype(np.int64), c)
            yield _row(r["dim"], r["kind"], r["ids"], r["known"], r["data"], best, near, _sums(x, best, near))


def _limbs(batches):
    """The sums of a task's blocks as (cluster, place, limb, value): value times 2**(30 * limb)."""
    total: dict[tuple[int, int], int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for line in text.decode().splitlines():
                c, *own = map(int, line.split(" "))
                for place, v in enumerate(own):
                    total[c, place] = total.get((c, place), 0) + v
    rows = []
    for (c, place), v in total.items():
        sign, v, limb = (1 if v >= 0 else -1), abs(v), 0
        while v or not limb:
            rows.append((c, place, limb, sign * (v & ((1 << _LIMB) - 1))))
            v, limb = v >> _LIMB, limb + 1
    for at in range(0, len(rows), 10_000):
        columns = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "value"])


def _totals(state: DataFrame) -> dict[int, list[int]]:
    """Count, summed distance and summed components of each cluster met: k rows."""
    found = state.select("sums").mapInArrow(_limbs, "cluster int, place int, limb int, value long")
    out: dict[int, dict[int, int]] = {}
    for c, place, limb, value in found.groupBy("cluster", "place", "limb").agg(F.sum("value")).collect():
        own = out.setdefault(c, {})
        own[place] = own.get(place, 0) + (value << (_LIMB * limb))
    return {c: [own[p] for p in range(len(own))] for c, own in out.items()}


def _explode(batches):
    for batch in batches:
        for r in batch.to_pylist():
            known = np.frombuffer(r["known"], "u1") == 0
            near = np.minimum(_unpack(r["far"], r["distance"]), _LONG) if r["far"] == "digits" else np.frombuffer(r["distance"], f"<{r['far']}")
            arrays = [pa.array(np.frombuffer(r["ids"], "<i8"), mask=known), pa.array(np.frombuffer(r["cluster"], "<i4")), pa.array(near.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, dict[int, list[int]], dict[int, list[int]]]:
    """(members, centroids, totals) of ``vectors`` (vec_id long, embedding array).

    Vectors with exactly ``dim`` components, none null or non-finite, take part; their
    components x, read as doubles, count as floor(scale * x).  The first centroids are the k vectors
    with the least sha256 of salt and vec_id, ties by the vector itself; fewer vectors give
    fewer centroids.  Members are (vec_id, cluster, distance), a row per vector, after
    ``rounds`` of assigning and averaging and one more of assigning.  Distances are squared
    and exact, one beyond 64 bits is cut to the most they hold.  Rows that repeat a vec_id
    or a vector each count, and a null vec_id hashes as the text "null".  No vectors give
    no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ballkmeans")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = _first(plain, k, dim, salt)
    centroids = {i: [int(v) for v in scaled(np.array(x, np.float64), scale).tolist()] for i, x in enumerate(first)}
    state = scratch.save(plain.mapInArrow(partial(_blocks, dim=dim, scale=scale, size=BLOCK), _STATE), "blocks")
    totals: dict[int, list[int]] = {}
    for n in range(rounds + 1 if centroids else 0):
        if n:
            for c, (count, _, *own) in totals.items():
                centroids[c] = [v // count for v in own]
        ordered = [centroids[c] for c in range(len(centroids))]
        before, state = state, scratch.save(state.mapInArrow(partial(_round, centroids=ordered), _STATE), f"round{n}")
        scratch.drop(before)
        totals = _totals(state)
    return state.select("ids", "known", "cluster", "far", "distance").mapInArrow(_explode, "vec_id long, cluster int, distance long"), centroids, totals


def _first(plain: DataFrame, k: int, dim: int, salt: str) -> list[list[float]]:
    """The k vectors whose ids hash least."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = plain.where((F.size("embedding") == dim) & ~bad)
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [r[0] for r in own.orderBy(key, "embedding").limit(k).select("embedding").collect()]


def clusters(vectors: DataFrame, **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector, as in
    ``ball_kmeans``; sums beyond 64 bits are cut as distances are."""
    members, centroids, totals = ball_kmeans(vectors, **settings)
    inertia = min(sum(t[1] for t in totals.values()), _LONG)
    rows = [(c, min(t[1], _LONG), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sorted(totals.items())]
    about = vectors.sparkSession.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(about), F.col("cluster") == F.col("c")).drop("c")
