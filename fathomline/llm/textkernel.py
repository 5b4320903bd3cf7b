"""Words of whole texts as arrays: one pass over an Arrow batch's bytes, no loop over words.

A word is a run of characters other than space and U+0009 to U+000D.  Words are
identified by 64-bit hashes of their bytes, taken block by block of 8 bytes and mixed
after each, so that no algebra of positions makes two words alike.  Words of up to 8
bytes with equal hashes and lengths are equal.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_rng = np.random.default_rng(20140603)
_BASE = 0x9E3779B97F4A7C17
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_STEP = _rng.integers(1, 2**63, 8, dtype=U64) * U64(2) + U64(1)
#: Bytes of a word that are hashed by array operations; longer words one by one.
BLOCKED = 64
_SALT = _rng.integers(1, 2**63, BLOCKED // 8 + 1, dtype=U64)
#: What the last block of a word keeps: its first 0 to 8 bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of text taken at a time.  A longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Rows of a batch between Spark and Python.
BATCH_ROWS = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end."""
    size = end - start
    out = mix(size.astype(U64) * U64(_BASE) + _SALT[-1])
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    own, at = None, start  # whose blocks are left, all at first
    for k in range(BLOCKED // 8):
        block = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        left = (size if own is None else size[own]) - 8 * k
        block &= _MASK[np.clip(left, 0, 8)]
        if own is None:
            out ^= mix(block + _SALT[k])
        else:
            out[own] = mix(out[own] * U64(_BASE) + mix(block + _SALT[k]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        own = more if own is None else own[more]
        at = start[own] + 8 * (k + 1)
    for i in np.flatnonzero(size > BLOCKED).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].data)
    return out


class Words:
    """Words of some texts: ``doc`` (ascending index into the texts), byte ``start`` and ``end``
    in ``data``, and their ``hash``.  ``first`` has each text's first word, and one more."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        solid = ~SPACE[data]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.empty_like(solid)
        if len(solid):
            before[1:] = solid[:-1]
            before[begin] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        if len(solid):
            after[:-1] = solid[1:]
            after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)
        if hashed:
            self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hash_ranges(self.data, start, end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of ``size`` words within a text, and the window's hash."""
        if len(self.doc) < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :])
        h = np.zeros(len(self.doc) - size + 1, U64)
        for k in range(size):
            h += self.hash[k : k + len(h)] * _STEP[k]
        return at, mix(h[at])

    def whole(self, i: int) -> np.uint64:
        """A hash of all the words of text i, in order."""
        h = np.array([self.count[i]], U64)
        for k in range(self.first[i], self.first[i + 1]):
            h = mix(h * U64(_BASE) + self.hash[k])
        return h[0]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, a null being empty, and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    if where is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES of text each, or one row."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _lean(batches, work, vocabulary: bool):
    """``work`` in a worker that keeps little between tasks: Arrow's buffers go back to the
    system, and a vocabulary that an earlier operator left is dropped."""
    pa.set_memory_pool(pa.system_memory_pool())
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens and not vocabulary:
        tokens.word_ids.cache_clear()
    yield from work(batches)
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_texts(df, work, schema, vocabulary: bool = False):
    """``df.mapInArrow`` in batches that stay small with texts in them, on both sides of the pipe.

    The session keeps these sizes of Arrow batches, as they are read when a query runs.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(partial(_lean, work=work, vocabulary=vocabulary), schema)


def words_of(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = buffers(texts)
    return Words(LOWER[data] if lower else data, offsets, hashed)
