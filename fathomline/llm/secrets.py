"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags a text's tokens as outside, begin or inside of a secret, from the
token's shape, its neighbours and features of the whole text, and is decoded by
Viterbi.  Tokens are prose words, and of other words the runs of letters and digits and
the signs between them.  Its labels come from the fixed patterns on a bounded sample: a
token that a pattern's secret covers begins one, and a token that continues it, on the
next line as well, is inside.  As the patterns know few forms, each text with a secret
is also shown with secrets of other alphabets, lengths and introductions planted in
their stead, among harmless words that look odd as well.  What the field learns is how
secrets look and what stands around them, so it also finds those that no pattern names.

Scores are sums of one weight per feature, looked up for whole slices of text at once.
Between tokens whose outside score beats all else by more than any transition can
give, the chain falls into short runs, and only those are decoded.
"""

from __future__ import annotations

import itertools
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .holdout import draw, share
from .textkernel import U64, Words, mix, map_texts, slices, words_of

KINDS = ("assign", "access", "hex")
#: Fixed patterns, and what a match needs.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What any text with a valid match holds, for a first look by a linear-time engine.
MAY = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")

OUT, BEGIN, INSIDE = range(3)
TAGS = 3
#: Features of a token.
WIDTH = 7
#: Weights of hashed features of a token; three places look at it: itself, next, previous.
DIM = 1 << 15
#: Documents with and without a secret that the field is fitted to, at most each.
SAMPLE = 2000
EPOCHS = 4
#: Tokens of a chain that a training text is cut into, or more up to the end of a secret.
RUN = 64
#: Bytes of a token of a word that is not prose, at most.
PIECE = 16
#: Least score by which a decoded span beats being outside.
MARGIN = 3.0
#: Spans of the field have at least so many characters, as the patterns' have.
LEAST = 8


def base_spans(text: str, may=(True, True, True)) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns' matches, by kind."""
    out = []
    if may[0]:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if may[1]:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if may[2]:
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return out


_CLASS = np.zeros((6, 256), bool)  # lower, upper, digit, of hex digits, sign of base64, other sign
_CLASS[0, 0x61:0x7B] = True
_CLASS[1, 0x41:0x5B] = True
_CLASS[2, 0x30:0x3A] = True
_CLASS[3, [*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_CLASS[4, list(b"+/_-=")] = True
_CLASS[5] = ~(_CLASS[0] | _CLASS[1] | _CLASS[2] | _CLASS[4])
_CLASS[5, 0x80:] = False
_SOLID = _CLASS[0] | _CLASS[1] | _CLASS[2]
_SOLID[0x80:] = True


class Tokens:
    """Tokens of some words, with their fields, and a number below 16 per text, ``kind``."""

    def __init__(self, words: Words):
        data = self.data = words.data
        self.offsets, self.n = words.offsets, words.n
        count = lambda flags: (lambda run: run[words.end] - run[words.start])(np.concatenate(([0], np.cumsum(flags, dtype=np.int32))))
        digit = count(_CLASS[2][data])
        length = words.end - words.start
        self.kind = text_features(words, {"digit": digit, "length": length})
        odd = (digit > 0) | (length > PIECE) | (count((data == 0x3A) | (data == 0x3D)) > 0)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[words.start[odd]] += 1
        edge[words.end[odd]] -= 1
        solid = _SOLID[data]
        turn = np.ones(len(data), bool)
        turn[1:] = solid[1:] != solid[:-1]
        turn[words.start] = True
        at = np.arange(len(data), dtype=np.int32)
        far = (at - np.maximum.accumulate(np.where(turn, at, 0))) % PIECE == 0
        cut = (np.cumsum(edge[:-1], dtype=np.int8) > 0) & (turn | far) & (data & 0xC0 != 0x80)
        cut[words.start] = False
        inner = np.flatnonzero(cut)
        del at, far, cut, turn, edge
        self.start, self.end = np.union1d(words.start, inner), np.union1d(words.end, inner)
        self.first = np.searchsorted(self.start, words.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)
        self.hash = words.hashes(self.start, self.end)
        # a sign means what it stands behind
        sign = np.flatnonzero(~solid[self.start[1:]] & (self.doc[1:] == self.doc[:-1])) + 1
        self.hash[sign] = mix(self.hash[sign] + mix(self.hash[sign - 1]))


def shapes(words: Words | Tokens | _Distinct) -> dict[str, np.ndarray]:
    """Per word: its length, its counts by class of character, and its changes of class."""
    data = words.data
    count = lambda flags: (lambda run: run[words.end] - run[words.start])(np.concatenate(([0], np.cumsum(flags, dtype=np.int32))))
    lower, upper, digit, hexa, base, other = (count(_CLASS[k][data]) for k in range(6))
    kind = np.select([_CLASS[0][data], _CLASS[1][data], _CLASS[2][data]], [1, 2, 3], 0)
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    run = np.concatenate(([0], np.cumsum(change, dtype=np.int32)))
    changes = np.maximum(run[words.end] - run[np.minimum(words.start + 1, words.end)], 0)
    length = words.end - words.start
    return {"length": length, "lower": lower, "upper": upper, "digit": digit, "hex": hexa, "base": base, "other": other, "changes": changes, "colon": count((data == 0x3A) | (data == 0x3D))}


def features(words: Tokens | _Distinct) -> np.ndarray:
    """Hashed features of each token: (tokens, features) of numbers below DIM.

    Only shape and, for words that look like prose, the word itself without signs: an
    unseen secret has no word of its own.
    """
    s = shapes(words)
    size = np.minimum(np.log2(np.maximum(s["length"], 1) + 1), 7).astype(np.int64)
    long_ = np.digitize(s["length"], [4, 8, 12, 16, 20, 24, 32, 40, 64])
    ratio = lambda x: np.minimum((4 * x) // np.maximum(s["length"], 1), 4)
    turn = np.minimum(s["changes"], 12)
    mixed = (s["lower"] > 0) + 2 * (s["upper"] > 0) + 4 * (s["digit"] > 0) + 8 * (s["base"] > 0) + 16 * (s["other"] > 0)
    prose = (s["digit"] == 0) & (s["length"] <= 12)
    key = np.where(prose, words.hash, U64(1))
    columns = [
        (1, long_ * 32 + mixed),
        (2, ratio(s["digit"]) * 8 + ratio(s["hex"])),
        (3, turn * 16 + long_),
        (4, ratio(s["upper"]) * 64 + ratio(s["lower"]) * 8 + ratio(s["digit"])),
        (5, (s["colon"] > 0) * 32 + size),
        (6, (s["hex"] == s["length"]) * 16 + long_),
    ]
    out = [mix(v.astype(U64) + U64(k << 32)) for k, v in columns] + [mix(key ^ U64(7 << 40))]
    return np.stack([(c & U64(DIM - 1)).astype(np.int32) for c in out], axis=1)


def text_features(words: Words, s: dict[str, np.ndarray]) -> np.ndarray:
    """Per text a number below 16: share of words with digits, and of long ones."""
    tot = np.maximum(words.count, 1)
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[words.first])
    a = np.digitize(per(s["digit"] > 0) / tot, [0.01, 0.05, 0.2])
    b = np.digitize(per(s["length"] > 16) / tot, [0.01, 0.05, 0.2])
    return a * 4 + b


class Field:
    """Weights: ``own``, ``before`` and ``after`` (DIM, TAGS), ``text`` (16, TAGS), ``move`` (TAGS, TAGS)."""

    SHAPES = {"own": (DIM, TAGS), "before": (DIM, TAGS), "after": (DIM, TAGS), "text": (16, TAGS), "move": (TAGS, TAGS)}

    def __init__(self):
        self.own, self.before, self.after = (np.zeros((DIM, TAGS), np.float32) for _ in range(3))
        self.text = np.zeros((16, TAGS), np.float32)
        self.move = np.zeros((TAGS, TAGS), np.float32)
        self.move[OUT, INSIDE] = -1e4  # nothing continues what has not begun

    @classmethod
    def of(cls, weights) -> Field:
        """The field whose weights a row has as bytes."""
        field = cls()
        for name, shape in cls.SHAPES.items():
            setattr(field, name, np.frombuffer(weights[name], np.float32).reshape(shape))
        return field

    def emissions(self, f: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
        e = self.own[f].sum(1) + self.text[text[doc]]
        if len(f) > 1:
            same = (doc[1:] == doc[:-1])[:, None]
            e[1:] += self.before[f[:-1]].sum(1) * same
            e[:-1] += self.after[f[1:]].sum(1) * same
        return e


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    score, back = e[0] + np.array([0, 0, -1e4]), []
    for x in e[1:]:
        each = score[:, None] + move
        back.append(each.argmax(0))
        score = each.max(0) + x
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def posterior(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of one length (runs, tokens, TAGS): marginals of tags and of moves to each
    token but the first, by forward and backward sums."""
    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return m.squeeze(axis) + np.log(np.exp(x - m).sum(axis))

    n = e.shape[1]
    a, b = np.zeros(e.shape), np.zeros(e.shape)
    a[:, 0] = e[:, 0] + np.array([0, 0, -1e4])
    for i in range(1, n):
        a[:, i] = e[:, i] + lse(a[:, i - 1, :, None] + move, 1)
    for i in range(n - 2, -1, -1):
        b[:, i] = lse(move + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
    z = lse(a[:, -1], 1)
    pair = np.exp(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None])
    return np.exp(a + b - z[:, None, None]), pair


def fit(sample: list[tuple[np.ndarray, int, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, size: int = 128) -> Field:
    """A field for (features, text feature, tags) of token runs, by adaptive gradient ascent on
    the conditional likelihood."""
    field = Field()
    if not sample:
        field.text[:, OUT] = 1e3
        return field
    order = np.random.default_rng(7)
    free = np.ones((TAGS, TAGS), bool)
    free[OUT, INSIDE] = False
    weights = [field.own, field.before, field.after, field.text, field.move]
    past = [np.full(w.shape, 1e-2, np.float32) for w in weights]
    for _ in range(epochs):
        turn = order.permutation(len(sample))
        for lo in range(0, len(turn), size):
            own = [sample[i] for i in turn[lo : lo + size]]
            n = max(len(f) for f, _, _ in own)
            f = np.concatenate([x for x, _, _ in own])
            doc = np.repeat(np.arange(len(own)), [len(x) for x, _, _ in own])
            at = np.concatenate([np.arange(len(x)) for x, _, _ in own])
            tags = np.concatenate([t for _, _, t in own])
            kind = np.array([t for _, t, _ in own])
            e = np.zeros((len(own), n, TAGS))
            e[:, :, 1:] = -1e4  # what pads a run is outside
            e[doc, at] = field.emissions(f, doc, kind)
            p, pair = posterior(e, field.move.astype(np.float64))
            g = -p[doc, at]
            g[np.arange(len(f)), tags] += 1
            g = (g / len(own)).astype(np.float32)
            same = doc[1:] == doc[:-1]
            grads = [np.zeros_like(w) for w in weights]
            for into, rows, part in ((grads[0], f, g), (grads[1], f[:-1][same], g[1:][same]), (grads[2], f[1:][same], g[:-1][same])):
                for k in range(TAGS):
                    into[:, k] = np.bincount(rows.ravel(), np.repeat(part[:, k], f.shape[1]), DIM)
            np.add.at(grads[3], kind[doc], g)
            inner = at[1:] > 0
            np.add.at(grads[4], (tags[:-1][inner], tags[1:][inner]), 1 / len(own))
            grads[4] -= pair[doc[1:][inner], at[1:][inner] - 1].sum(0) / len(own)
            grads[4] *= free
            for w, h, d in zip(weights, past, grads, strict=True):
                h += d * d
                w += rate * d / np.sqrt(h)
    return field


def _covered(words: Words | Tokens, i: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of text i's tokens, given the byte ranges of its secrets."""
    lo, hi = words.first[i], words.first[i + 1]
    tags = np.full(hi - lo, OUT)
    for a, b in spans:
        at = np.flatnonzero((words.start[lo:hi] < b) & (words.end[lo:hi] > a))
        tags[at] = INSIDE
        tags[at[:1]] = BEGIN
    return tags


def _values(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of the secrets themselves: of an assignment, the value."""
    out = []
    for kind, a, b in found:
        if kind == 0:
            a = ASSIGN.match(text, a).start(2)
        out.append((a, b))
    return sorted(out)


def _secrets(text: str) -> list[tuple[int, int]]:
    """Ranges of secrets for the field: values that overlap or go on in the next line are one."""
    out: list[tuple[int, int]] = []
    for a, b in _union(_values(text, base_spans(text))):
        gap = text[out[-1][1] : a] if out else ""
        if out and gap.isspace() and "\n" in gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _runs(tags: np.ndarray) -> list[slice]:
    """Chains of RUN tokens, none of which begins inside a secret."""
    out, lo = [], 0
    while lo < len(tags):
        hi = min(lo + RUN, len(tags))
        while hi < len(tags) and tags[hi] == INSIDE:
            hi += 1
        out.append(slice(lo, hi))
        lo = hi
    return out


#: What planted secrets are drawn from, and how some are introduced.  Fixed values.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER, _LOWER.upper() + "234567", _DIGITS + _LOWER + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper() + "+/")
KEYS = ("password", "secret", "token", "api_key", "key", "auth", "pass", "credentials")
SIGNS = (" = ", "=", ": ", ":", " ", " is ")
PLANTED, HARMLESS = 6, 6


def _plant(draw: np.random.Generator) -> tuple[str, int, int]:
    """A secret with what introduces it, and where its value lies."""
    abc = list(ALPHABETS[draw.integers(len(ALPHABETS))])
    named = draw.random() < 0.6
    short = named and draw.random() < 0.5
    value = "".join(draw.choice(abc, int(draw.integers(8, 17) if short else draw.integers(20, 49))))
    look = draw.random()
    if look < 0.2:
        size = int(draw.integers(4, 9))
        value = "-".join(value[k : k + size] for k in range(0, len(value), size))
    elif look < 0.4:
        value = "".join(draw.choice(list(_LOWER), int(draw.integers(2, 5)))) + "_" + value
    if not named:
        return value, 0, len(value)
    quote = ("", '"', "'")[draw.integers(3)]
    lead = KEYS[draw.integers(len(KEYS))] + SIGNS[draw.integers(len(SIGNS))] + quote
    return lead + value + quote, len(lead), len(lead) + len(value)


def _harmless(draw: np.random.Generator) -> str:
    """A word that looks odd and is no secret."""
    word = lambda n: "".join(draw.choice(list(_LOWER), n))
    number = lambda n: "".join(draw.choice(list(_DIGITS), n))
    forms = (
        lambda: f"https://www.{word(7)}.com/{word(5)}/{word(8)}?page={number(2)}",
        lambda: f"{word(6)}.{word(5)}{number(2)}@{word(7)}.example.com",
        lambda: f"20{number(2)}-0{draw.integers(1, 10)}-1{draw.integers(10)}",
        lambda: f"v{draw.integers(20)}.{draw.integers(30)}.{draw.integers(99)}",
        lambda: f"+1-{number(3)}-{number(3)}-{number(4)}",
        lambda: f"/usr/{word(5)}/{word(8)}/{word(6)}{draw.integers(9)}.txt",
        lambda: f"{word(4)}{word(5).title()}{word(6).title()}{draw.integers(10)}",
        lambda: f"{number(2)},{number(3)}.{number(2)}",
        lambda: number(int(draw.integers(6, 17))),
        lambda: word(int(draw.integers(14, 40))),
        lambda: f"{word(9)}_{word(8)}_{word(5)} = {number(3)}",
        lambda: f"#{number(6)}",
    )
    return forms[draw.integers(len(forms))]()


def _variant(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with others in place of its secrets, PLANTED more and HARMLESS odd words between its
    words, and where the secrets are.  Drawn by the text, so runs agree."""
    draw = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode()))
    gaps = np.array([i for i, c in enumerate(text) if c == " " and not any(a <= i < b for a, b in base)], int)
    drawn = draw.choice(gaps, min(len(gaps), PLANTED + HARMLESS), replace=False).tolist()
    edits = [(a, b, _plant(draw)) for a, b in base]
    edits += [(g, g, (" " + p[0], p[1] + 1, p[2] + 1)) for g in drawn[:PLANTED] for p in [_plant(draw)]]
    edits += [(g, g, (" " + _harmless(draw), 0, 0)) for g in drawn[PLANTED:]]
    out, at, size, ranges = [], 0, 0, []
    for a, b, (new, lo, hi) in sorted(edits):
        out += [text[at:a], new]
        size += a - at
        if hi:
            ranges.append((size + lo, size + hi))
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), ranges


def _chains(texts: list[str], ranges: list[list[tuple[int, int]]]):
    """Features, text feature and tags of all tokens of texts, as chains."""
    words = Tokens(words_of(pa.array(texts, pa.string()), hashed=False))
    f = features(words).astype(np.uint16)  # DIM at most
    for i, (text, own) in enumerate(zip(texts, ranges, strict=True)):
        shift = int(words.offsets[i])
        tags = _covered(words, i, [(len(text[:a].encode()) + shift, len(text[:b].encode()) + shift) for a, b in own])
        rows = f[words.first[i] : words.first[i + 1]]
        yield from ((rows[cut].tobytes(), int(words.kind[i]), tags[cut].astype(np.int8).tobytes()) for cut in _runs(tags))


def _training(batches):
    """All tokens of texts, and of variants of those with a secret, as chains."""
    for batch in batches:
        for part in slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ranges = [_secrets(t) for t in texts]
            more = [_variant(t, _union((a, b) for _, a, b in base_spans(t))) for t, r in zip(texts, ranges, strict=True) if r]
            rows = list(_chains([*texts, *(t for t, _ in more)], [*ranges, *(r for _, r in more)]))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["features", "kind", "tags"])


def _thinned(texts: DataFrame, which: F.Column, total: int, sample: int) -> DataFrame:
    """At most ``sample`` of the ``total`` texts for which ``which`` holds, those with the least draws.

    Draws come first, so that the patterns look at few texts.
    """
    drawn = texts.withColumn("key", draw("doc_id", "text")).where(F.col("key") < share(sample, total))
    return drawn.where(which).orderBy("key").limit(sample)


def train(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted to at most ``sample`` documents with a secret of the fixed patterns, each as it
    is and with others planted, and as many without, those with the least draws, on all
    their tokens."""
    may = F.lit(False)
    for p in MAY:
        may = may | F.coalesce(F.col("text").rlike(p), F.lit(False))
    texts = documents.where("text is not null").select("doc_id", "text")
    row = texts.agg(F.coalesce(F.sum(may.cast("long")), F.lit(0)), F.count("*")).first()
    picked = _thinned(texts, may, row[0], sample).union(_thinned(texts, ~may, row[1] - row[0], sample))
    chains = map_texts(picked.select("text"), _training, "features binary, kind long, tags binary").repartition(1)
    chains = chains.sortWithinPartitions(F.length("features"), "features", "kind", "tags")  # the same order wherever they came from
    weights = map_texts(chains, _fitted, ", ".join(f"{w} binary" for w in Field.SHAPES)).first()
    return Field.of(weights) if weights else fit([])


def _cells(column: pa.Array, kind) -> list[np.ndarray]:
    """The cells of a binary column as arrays over its buffer."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(column.buffers()[2], kind, (hi - lo) // kind().itemsize, lo) for lo, hi in itertools.pairwise(at)]


def _fitted(batches):
    """The weights of a field fitted to all chains, in one task, so that the driver sees those of fixed size alone."""
    rows = []
    for batch in batches:
        f, kind, tags = (batch.column(c) for c in ("features", "kind", "tags"))
        rows += zip((x.reshape(-1, WIDTH) for x in _cells(f, np.uint16)), kind.to_pylist(), _cells(tags, np.int8), strict=True)
    field = fit(rows)
    yield pa.RecordBatch.from_pydict({w: pa.array([getattr(field, w).tobytes()], pa.binary()) for w in Field.SHAPES})


class _Distinct:
    """The distinct tokens of a slice, and which of them each token is."""

    def __init__(self, words: Tokens):
        self.hash, first, self.which = np.unique(words.hash, return_index=True, return_inverse=True)
        self.data, self.start, self.end = words.data, words.start[first], words.end[first]


def decode(field: Field, words: Words) -> list[tuple[int, int, int]]:
    """(text, first word, end word) of what ``decode_tokens`` finds, as whole words."""
    found = decode_tokens(field, Tokens(words))
    at = lambda x, side: np.searchsorted(words.start, x, side)
    return [(doc, int(at(a, "right")) - 1, int(at(b, "left"))) for doc, a, b in found]


def decode_tokens(field: Field, words: Tokens) -> list[tuple[int, int, int]]:
    """(text, first byte, end byte) of the spans that the field tags, MARGIN better than outside."""
    if not len(words.start):
        return []
    # a token's scores for itself and for its neighbours are the same wherever it stands
    distinct = _Distinct(words)
    f, which = features(distinct), distinct.which
    e = field.own[f].sum(1)[which] + field.text[words.kind[words.doc]]
    same = (words.doc[1:] == words.doc[:-1])[:, None]
    e[1:] += field.before[f].sum(1)[which[:-1]] * same
    e[:-1] += field.after[f].sum(1)[which[1:]] * same
    reach = np.abs(field.move[field.move > -1e3]).max() * 2
    hot = e[:, 1:].max(1) + reach >= e[:, OUT]
    if not hot.any():
        return []
    edge = np.flatnonzero(hot)
    # runs of such tokens, with one certain token on either side, within a text
    cut = np.flatnonzero((np.diff(edge) > 1) | (words.doc[edge[1:]] != words.doc[edge[:-1]]))
    out = []
    for a, b in zip(np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(edge) - 1])), strict=True):
        lo, hi = edge[a], edge[b] + 1
        doc = words.doc[lo]
        lo, hi = max(lo - 1, words.first[doc]), min(hi + 1, words.first[doc + 1])
        tags = viterbi(e[lo:hi].astype(np.float64), field.move.astype(np.float64))
        for x in np.flatnonzero(tags == BEGIN):
            y = x + 1
            while y < len(tags) and tags[y] == INSIDE:
                y += 1
            # a secret may go on in the next line, but not behind a space
            gaps = [x, *(k for k in range(x + 1, y) if (words.data[words.end[lo + k - 1] : words.start[lo + k]] == 0x20).any()), y]
            for x, y in itertools.pairwise(gaps):
                gain = e[np.arange(lo + x, lo + y), tags[x:y]].sum() - e[lo + x : lo + y, OUT].sum()
                a, b = int(words.start[lo + x]), int(words.end[lo + y - 1])
                if gain >= MARGIN and b - a >= LEAST:
                    out.append((int(doc), a, b))
    return out


SCHEMA = "n_assign long, n_access long, n_hex long, base_spans array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(part: pa.RecordBatch, field: Field) -> list[tuple[list, list]]:
    """For each row (its fixed spans, all its spans), each (kind, start, end), by start, then kind."""
    texts = part.column("text").fill_null("")
    may = np.array([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in MAY])
    tokens = Tokens(words_of(texts, hashed=False))
    extra: dict[int, list] = {}
    for doc, a, b in decode_tokens(field, tokens):
        extra.setdefault(doc, []).append((int(a - tokens.offsets[doc]), int(b - tokens.offsets[doc])))
    hit = np.flatnonzero(may.any(0))
    out: list[tuple[list, list]] = [([], [])] * len(texts)
    for i in sorted({*hit.tolist(), *extra}):
        text = texts[i].as_py()
        base = sorted(base_spans(text, may[:, i]), key=lambda s: (s[1], s[0]))
        raw = text.encode()
        more = []
        for a, b in extra.get(i, []):
            lo, b = len(raw[:a].decode()), len(raw[:b].decode())
            # what the fixed spans leave of it
            for c, d in [*_union((s, e) for _, s, e in base), (b, b)]:
                a, c = lo, min(max(c, lo), b)
                while a < c and not text[a].isalnum():
                    a += 1
                while a < c and not text[c - 1].isalnum():
                    c -= 1
                if c - a >= LEAST:
                    more.append((3, a, c))
                lo = max(lo, d)
        names = (*KINDS, "field")
        named = lambda spans: [{"kind": names[k], "start": a, "end": b} for k, a, b in spans]
        out[i] = (named(base), named(sorted(base + more, key=lambda s: (s[1], s[0]))))
    return out


def _work(batches, field):
    for batch in batches:
        for part in slices(batch):
            found = scan(part, field.value)
            count = [pa.array([sum(s["kind"] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *count, pa.array([b for b, _ in found], _SPANS), pa.array([s for _, s in found], _SPANS)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def find_secrets(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, n_assign, n_access, n_hex, base_spans and spans.

    Spans are (kind, start, end) in code points, end exclusive, by start and then kind;
    base_spans has the fixed patterns' matches, and spans those and the field's (kind
    ``field``), which never overlap them: of a span that does, what they leave.  The field is fitted to ``documents`` unless
    given.  A null or empty text has no spans.  Rows that repeat an id or a text, and
    null ids, are scanned each; where no text holds a secret, the field finds none.
    Whole texts are read, however long.  Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))  # of fixed size
    return map_texts(documents.select("doc_id", "text"), partial(_work, field=shared), f"doc_id long, {SCHEMA}")


def _union(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mask(batches, field, mark):
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").to_pylist()
            for i, (_, spans) in enumerate(scan(part, field.value)):
                for a, b in reversed(_union((s["start"], s["end"]) for s in spans)):
                    texts[i] = texts[i][:a] + mark + texts[i][b:]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def mask_secrets(documents: DataFrame, field: Field | None = None, mark: str = "<SECRET>") -> DataFrame:
    """``documents`` with what the spans of ``find_secrets`` cover replaced by ``mark``, once for spans that overlap."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train(documents))
    return map_texts(documents, partial(_mask, field=shared, mark=mark), documents.schema)
