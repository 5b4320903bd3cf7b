"""Token ids of whole texts, each distinct unit of a text encoded once.

A text is cut into units that its tokenizer never joins, so a text's ids are its units'
ids in a row.  One tokenizer lower-cases and drops white space: its units are words.
The other keeps white space: a unit is a run of spaces and what follows up to the next
space, and a white-space character that no piece holds is a unit alone.  A worker keeps
the ids of the units it saw last, up to a bound, in sorted arrays that a whole slice is
looked up in at once.  Units are found by hash and then compared by their bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .textkernel import U64, Words, buffers, hash_ranges, mix

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SPACE_MARK = "\u2581".encode()
#: Units of up to so many bytes are equal if their hashes and lengths are.
EXACT = 8


class Units:
    """Units of some texts as byte ranges: ``doc``, ``start``, ``end``, ``first`` as in Words, and
    ``opens``, whether a unit begins its text.  ``alone`` marks the bytes that are a unit each."""

    def __init__(self, texts, alone: np.ndarray):
        data, offsets = self.data, self.offsets = buffers(texts)
        self.n = len(offsets) - 1
        lone, space = alone[data], data == 0x20
        if len(data) > 2:  # the model takes its own mark of a space for one
            mark = np.flatnonzero((data[:-2] == SPACE_MARK[0]) & (data[1:-1] == SPACE_MARK[1]) & (data[2:] == SPACE_MARK[2]))
            space[(mark[:, None] + np.arange(3)).ravel()] = True
        cut = lone.copy()
        if len(data):
            cut[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
            cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], len(data))[: len(self.start)]
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.opens = np.zeros(len(self.start), bool)
        self.opens[self.first[:-1][self.count > 0]] = True


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of ranges in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def differ(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of one size hold other bytes in ``a`` than in ``b``."""
    wrong = a[_ranges(a_start, size)] != b[_ranges(b_start, size)]
    return np.bincount(np.repeat(np.arange(len(size)), size)[wrong], minlength=len(size)) > 0


class WordIds:
    """Ids by unit.  ``encode`` takes a list of (string, whether it opens a text) and returns a
    list of id lists; ``strip`` parts a closing full stop or comma from a word that ends
    in a letter, where the tokenizer does so as well."""

    def __init__(self, encode, most: int = 700_000, strip: bool = True, alone: np.ndarray | None = None):
        self.encode, self.most, self.strip, self.alone = encode, most, strip, alone
        self.clear()
        self.marks = {c: np.array(encode([(chr(c), True)])[0], np.int32) for c in b".,"} if strip else {}

    def clear(self):
        # by hash, in order: where a unit's ids are, how many, and where its bytes are
        self.hash, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.from_, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are among those known, and whether they are."""
        place = np.searchsorted(self.hash, keys)
        place[place == len(self.hash)] = 0
        return place, self.hash[place] == keys if len(self.hash) else np.zeros(len(keys), bool)

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and how many each has, from the tokenizer itself."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for lo in range(0, len(start), ENCODE):
            own = slice(lo, lo + ENCODE)
            found = self.encode([(data[a:b].tobytes().decode("utf-8", "replace"), o) for a, b, o in zip(start[own].tolist(), end[own].tolist(), opens[own].tolist(), strict=True)])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((x for f in found for x in f), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, units: Words | Units) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in a row, and how many each unit has."""
        start, end, data = units.start, units.end, units.data
        opens = units.opens if self.alone is not None else np.ones(len(start), bool)
        mark = np.zeros(len(start), np.uint8)
        if self.strip and len(start):
            last, before = data[end - 1], data[np.maximum(end - 2, 0)]
            cut = ((last == 0x2E) | (last == 0x2C)) & (end - start > 1) & _LETTER[before]
            mark[cut] = last[cut]
            end = end - cut
        keys = hash_ranges(data, start, end)
        if self.alone is not None:
            keys[opens] = mix(keys[opens])
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.hash) > self.most:
            self.clear()
        place, known = self._look(distinct)
        new = np.flatnonzero(~known)
        if len(new):
            own = first[new]
            ids, size = self._encoded(data, start[own], end[own], opens[own])
            at = len(self.ids) + np.cumsum(size) - size
            length = end[own] - start[own]
            from_ = len(self.bytes) + np.cumsum(length) - length
            self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, data[_ranges(start[own], length)]])
            where = np.searchsorted(self.hash, distinct[new])
            self.hash, self.at, self.size, self.from_, self.length = (np.insert(old, where, x) for old, x in ((self.hash, distinct[new]), (self.at, at), (self.size, size), (self.from_, from_), (self.length, length)))
            place, _ = self._look(distinct)
        place = place[inverse]
        odd = self._strangers(data, start, end, place)
        ids, size, at = self.ids, self.size[place], self.at[place]
        if len(odd):  # of one hash with another unit: their ids are not kept
            more, own = self._encoded(data, start[odd], end[odd], opens[odd])
            at[odd], size[odd] = len(ids) + np.cumsum(own) - own, own
            ids = np.concatenate([ids, more])
        total = size.copy()
        for c, x in self.marks.items():
            total[mark == c] += len(x)
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[_ranges(ends - total, size)] = ids[_ranges(at, size)]
        for c, own in self.marks.items():
            for k, x in enumerate(own):
                out[(ends - len(own) + k)[mark == c]] = x
        return out, total

    def _strangers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those of the known unit that their hash found."""
        size = end - start
        odd = size != self.length[place]
        long_ = np.flatnonzero(~odd & (size > EXACT))
        odd[long_] = differ(data, start[long_], self.bytes, self.from_[place[long_]], size[long_])
        return np.flatnonzero(odd)


#: Units encoded at a time: an encoder's results take about a kilobyte each.
ENCODE = 8192


@lru_cache(maxsize=1)
def word_ids(kind: str, path: str) -> WordIds:
    """The last vocabulary used in a worker, whose units the next tasks find again."""
    if kind == "tokenizer":
        return WordIds(tokenizer(path))
    encode, alone = pieces(path)
    return WordIds(encode, strip=False, alone=alone)


def tokenizer(path: str):
    """The encoder of a tokenizers file for words, without special tokens added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    return lambda words: [e.ids for e in loaded.encode_batch_fast([w for w, _ in words], add_special_tokens=False)]


def pieces(path: str):
    """The encoder of a sentencepiece model for units, and the bytes that are a unit alone.

    No piece holds a space after another character, nor those white-space characters,
    so nothing is joined across a unit's ends.  A unit inside a text is encoded behind a
    line break, as the model puts a space before whatever begins a text.
    """
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    held = {c for i in range(len(loaded)) if not loaded.IsByte(i) for c in loaded.IdToPiece(i)}
    alone = np.zeros(256, bool)
    alone[[b for b in range(0x09, 0x0E) if chr(b) not in held]] = True
    skip = len(loaded.encode("\n"))

    def encode(units):
        found = loaded.encode([u if o else "\n" + u for u, o in units], num_threads=1)
        return [f if o else f[skip:] for f, (_, o) in zip(found, units, strict=True)]

    return encode, alone
