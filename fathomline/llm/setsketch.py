"""SetSketch: registers that are maxima of exponentially spaced, truncated minima.

Each element has a rising sequence of random points, the j-th drawn from an
exponential distribution truncated to the j-th of M adjoining intervals, and sends
them to the registers in an order of its own.  A register keeps the least point x it
sees, as k = floor(1 - log_b x), so sketches of parts merge by a plain maximum.  Two
sketches agree in a register about as often as their sets are similar, and counts of
registers above, below and equal give a likelihood of the similarity (Ertl, 2021).
"""

from __future__ import annotations

import numpy as np

from .textkernel import U64, mix

M = 512
RATE = 20.0
LOG_BASE = float(np.log(1.1))
BASE = 1.1
#: Rows of a band and bands: sets at 0.75 share none with a chance below one in a million.
ROWS, BANDS = 5, 48

_levels = np.arange(M + 1)
with np.errstate(divide="ignore"):
    #: Bounds of the intervals from which the j-th points are drawn; the last is open.
    BOUND = np.log1p(_levels / (M - _levels + 0.0)) / RATE
_GOLD = 0x9E3779B97F4A7C15


def _salts(n: int) -> np.ndarray:
    return (np.arange(1, n + 1, dtype=object) * _GOLD % (1 << 64)).astype(U64)


_SALT = _salts(M)


def sketch(elements: np.ndarray) -> np.ndarray:
    """M registers of one byte for a non-empty array of distinct 64-bit hashes.

    Only as many points per element are drawn as can be minima: later intervals lie
    above earlier ones, so once every register has a point, the rest cannot matter.
    """
    n = len(elements)
    first = mix(elements ^ U64(0x5851F42D4C957F2D))
    at, step = first & U64(M - 1), (first >> U64(20)) & U64(M - 1) | U64(1)
    key = np.full(M, np.inf)
    done, levels = 0, min(M, int(M * (np.log(M) + 4) / n) + 1)
    while True:
        j = np.arange(done, levels, dtype=U64)
        u = (mix(elements[None, :] + _SALT[done:levels, None]) >> U64(12)) * 2.0**-52
        np.minimum.at(key, ((at + step * j[:, None]) & U64(M - 1)).ravel().astype(np.int64), (u + j[:, None]).ravel())
        if levels == M or np.isfinite(key).all():
            break
        done, levels = levels, min(M, levels * 2)
    level = key.astype(np.int64)
    u = key - level
    low, high = BOUND[level], BOUND[level + 1]
    x = low - np.log1p(-u * -np.expm1(-RATE * (high - low))) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / LOG_BASE)
    return np.clip(k, 0, 255).astype(np.uint8)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / LOG_BASE


def similarity(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 24) -> np.ndarray:
    """The likeliest Jaccard similarity, given how many of M registers of the first set
    are above and below the second's and the sets' sizes n and m."""
    u, v = n / (n + m), m / (n + m)
    same = M - above - below
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def fit(j):
        p, q = _share(np.maximum(u - v * j, 0)), _share(np.maximum(v - u * j, 0))
        return above * np.log(p + 1e-12) + below * np.log(q + 1e-12) + same * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(steps):  # the likelihood has one peak
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = fit(a) > fit(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def pairs_to_confirm(left: np.ndarray, ln: np.ndarray, right: np.ndarray, rn: np.ndarray, apart: np.ndarray, band: int, least: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``left`` x ``right`` sketches to confirm, as two index arrays.

    ``apart`` marks pairs that count.  Those stay whose sizes allow ``limit``, whose
    estimate is ``least`` or more, and whose first common band is ``band``: each pair
    is taken in one bucket of all that hold it.
    """
    out_a, out_b = [], []
    for i in range(len(left)):
        j = np.flatnonzero(apart[i] & (np.minimum(ln[i], rn) >= limit * np.maximum(ln[i], rn)))
        if not len(j):
            continue
        same = right[j] == left[i]
        keep = same.sum(1) >= M * (least - 0.06)
        j, same = j[keep], same[keep]
        if not len(j):
            continue
        at = same[:, : ROWS * BANDS].reshape(len(j), BANDS, ROWS).all(2).argmax(1) == band
        j = j[at]
        above, below = (left[i] > right[j]).sum(1), (left[i] < right[j]).sum(1)
        j = j[similarity(above, below, np.full(len(j), ln[i], float), rn[j].astype(float)) >= least]
        out_a.append(np.full(len(j), i))
        out_b.append(j)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))
