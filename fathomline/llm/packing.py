"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces: whole windows first, which need no packing, and what
remains into pieces of a quarter window at most.  Pieces of a block of windows are
dealt by differencing: the two partial partitions with the largest imbalance are
merged, the fullest window of one with the emptiest of the other, until one is left.
Windows come out almost equal; when one is over capacity, their number rises and the
block is dealt again.  A block lives in one task and needs no shuffle, and a window
never holds rows of two tasks, so a task that is run again changes nothing elsewhere.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textkernel import buffers, map_texts, slices, words_of
from .tokens import word_ids

WINDOW = 4096
END_ID = 2
#: Windows dealt together.
BLOCK_WINDOWS = 192


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in k groups of nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: sums of its groups, largest first; groups left out are empty
    heap = [(-s, i, np.array([s]), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ga, b, gb = b, gb, a, ga
        free = k - len(a)
        if len(b) <= free:
            sums, groups = np.concatenate([a, b]), ga + gb
        else:  # the largest of b go to empty groups, the rest to the smallest of a
            rest = len(b) - free
            sums, groups = np.concatenate([a, b[:free]]), ga + gb[:free]
            for n, (s, g) in enumerate(zip(b[free:], gb[free:], strict=True)):
                at = len(a) - rest + (rest - 1 - n)
                sums[at] += s
                groups[at] = groups[at] + g
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        groups = [groups[i] for i in order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), tick, sums, groups))
        tick += 1
    groups = heap[0][3] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def deal(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Positions of ``sizes``, each at most ``window``, in windows that none exceeds."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return [g for g in groups if g]
        k += max(1, k // 100)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(batches, path: str, window: int, end_id: int):
    words_to_ids = word_ids("tokenizer", path)
    sequence = TaskContext.get().partitionId() << 40
    piece_most = max(1, window // 4)
    rows: list[tuple] = []
    held: list[tuple] = []
    held_tokens = 0

    def flush(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def block():
        nonlocal sequence, held_tokens
        for group in deal([h[2] for h in held], window):
            offset = 0
            for i in sorted(group):
                rows.append((*held[i], sequence, offset))
                offset += held[i][2]
            sequence += 1
        held.clear()
        held_tokens = 0

    for batch in batches:
        for part in slices(batch):
            # the tokenizer lower-cases all but its special tokens' strings, as they stand
            raw, _ = buffers(part.column("text"))
            words = words_of(part.column("text"), lower=b"<|" not in raw.tobytes(), hashed=False)
            ids, size = words_to_ids(words)
            ends = np.concatenate(([0], np.cumsum(size)))[words.first]
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.int32(end_id)).astype("<u4")
                n, at = len(own), 0
                while n - at >= window:
                    rows.append((doc, at, window, own[at : at + window].tobytes(), n, sequence, 0))
                    sequence += 1
                    at += window
                while at < n:
                    take = min(piece_most, n - at)
                    held.append((doc, at, take, own[at : at + take].tobytes(), n))
                    held_tokens += take
                    at += take
                if held_tokens >= BLOCK_WINDOWS * window:
                    block()
                if len(rows) >= 2000:
                    yield flush(rows)
                    rows.clear()
    if held:
        block()
    if rows:
        yield flush(rows)


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    One row a piece: doc_id, start (the document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the closing ``end_id``),
    sequence_id and offset there; offsets of a sequence have no gap.

    A null or empty text has only its closing id.  Rows that repeat an id or a text
    are packed each; a null doc_id is kept.  Very long texts are cut, never dropped.
    No rows give no rows; other columns are ignored.
    """
    work = partial(_pack, path=tokenizer_path, window=window, end_id=end_id)
    return map_texts(documents.select("doc_id", "text"), work, SCHEMA, vocabulary=True)
