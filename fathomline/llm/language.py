"""Language identification: sparse multinomial logistic regression on character n-grams.

A text's features are the one- to three-grams of its letters (a space stands for all
else), weighed by how often they occur in the text and how few documents have them.
The document counts come from all documents that may teach; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample, and
their scores are calibrated by a temperature on documents kept aside.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch
from .holdout import draw, held_out, share, within
from .textkernel import U64, mix, map_texts, slices, words_of
from .toxicity import Ftrl

DIM = 1 << 15
#: Labelled documents that the weights are fitted to at most, those with the least draws.
SAMPLE = 4000
#: Features (8 bytes each, with their counts) that these have in all, or up to DIM more.
MOST_FEATURES = 1 << 23
EPOCHS = 2
UNKNOWN = "und"
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """N-grams of some texts, found once for each distinct word of a slice.

    A word is taken between two spaces.  Word w of a text is the distinct word
    ``which[w]``, whose features are ``at[edge[k]:edge[k + 1]]``.  ``total`` counts each
    text's n-grams and ``letters`` its letters.
    """

    def __init__(self, texts: pa.Array):
        words = words_of(texts)
        _, first, self.which = np.unique(words.hash, return_index=True, return_inverse=True)
        self.first, self.n = words.first, words.n
        start, size = words.start[first], words.end[first] - words.start[first]
        # the distinct words' bytes, each between spaces
        offsets = np.concatenate(([0], np.cumsum(size + 2)))
        data = np.full(offsets[-1], 0x20, np.uint8)
        shift = np.repeat(offsets[:-1] + 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else np.zeros(0, int)
        run = np.arange(int(size.sum()))
        data[shift + run] = words.data[np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + run] if len(size) else 0
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))[offsets]
        c = _letters()[points]
        own = np.repeat(np.arange(len(size)), np.diff(starts))
        letter = c != 0x20
        letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[starts])
        # of spaces in a row the first counts, and words without letters not at all
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[starts[:-1][letters > 0]] = True
        c, own = c[keep].astype(U64), own[keep]
        grams, whose = [mix(c)[c != U64(0x20)]], [own[c != U64(0x20)]]
        for n in (2, 3):
            if len(c) >= n:
                ok = own[n - 1 :] == own[: len(own) - n + 1]
                h = sum(c[k : len(c) - n + 1 + k] * _ODD[k] for k in range(n)) + U64(n)
                grams.append(mix(h)[ok])
                whose.append(own[: len(own) - n + 1][ok])
        whose = np.concatenate(whose)
        order = np.argsort(whose, kind="stable")
        self.at = (np.concatenate(grams) & U64(DIM - 1)).astype(np.int32)[order]
        self.edge = np.searchsorted(whose[order], np.arange(len(size) + 1))
        self.letters = self.per_text(letters)
        self.total = self.per_text(np.diff(self.edge))

    def per_text(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over each text's words of what distinct words have."""
        run = np.cumsum(per_word[self.which], axis=0, dtype=np.float64)
        run = np.concatenate((np.zeros((1, *run.shape[1:])), run))
        return run[self.first[1:]] - run[self.first[:-1]]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per text the sum of its n-grams' rows of ``weights``."""
        run = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[self.at], axis=0, dtype=np.float64)))
        return self.per_text(run[self.edge[1:]] - run[self.edge[:-1]])

    def features(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, features and counts of the n-grams of the distinct words of texts i to j."""
        lo, hi = self.first[i], self.first[j]
        doc = np.repeat(np.arange(i, j), np.diff(self.first[i : j + 1]))
        n = max(len(self.edge) - 1, 1)
        pair, times = np.unique((doc - i) * n + self.which[lo:hi], return_counts=True)
        word = pair % n
        size = self.edge[word + 1] - self.edge[word]
        at = np.repeat(self.edge[word] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(word) else np.zeros(0, int)
        return np.repeat(pair // n, size), self.at[at], np.repeat(times, size)

    def present(self, block: int = 512) -> np.ndarray:
        """How many of the texts have each feature."""
        out = np.zeros(DIM, np.int64)
        for lo in range(0, self.n, block):
            hi = min(lo + block, self.n)
            doc, at, _ = self.features(lo, hi)
            seen = np.zeros((hi - lo, DIM), bool)
            seen[doc, at] = True
            out += np.count_nonzero(seen, axis=0)
        return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (DIM, languages), times the features' inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, grams: Grams) -> np.ndarray:
        return grams.sums(self.weights) / np.maximum(grams.total, 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least mean negative log-likelihood.

    Labels count as right but for one part in their number, or else a sample without an
    error would ask for certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(labels) + 2)
    want = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    want[np.arange(len(labels)), labels] = 1 - doubt
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 120))
    loss = [-(want * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, idf: np.ndarray, epochs: int = EPOCHS, scale: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, n) and biases for rows of (features, counts)."""
    model = Ftrl((DIM + 1, n), alpha=0.5, first=0.05, second=0.01)
    draw = np.random.default_rng(5)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, count = rows[i]
            x = np.append(scale * idf[at] * count / count.sum(), 1.0)
            at = np.append(at, DIM)
            w = model.at(at)
            g = softmax(x @ w)
            g[labels[i]] -= 1
            model.learn(at, w, x[:, None] * g[None, :])
    w = model.at(np.arange(DIM + 1))
    return w[:DIM] * (scale * idf)[:, None], w[DIM]


def _frequency(batches):
    total, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for part in slices(batch):
            total += Grams(part.column("text")).present()
            n += part.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "documents"])


def _training(batches):
    for batch in batches:
        rows = []
        for part in slices(batch):
            grams = Grams(part.column("text"))
            for i in range(grams.n):
                _, at, times = grams.features(i, i + 1)
                at, whose = np.unique(at, return_inverse=True)
                count = np.bincount(whose, weights=times).astype(np.int64)
                rows.append((at.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), len(at)))
        a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), batch.column("lang"), batch.column("key")], names=["features", "counts", "size", "lang", "key"])


def train(documents: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> Model:
    """A model from the documents that are not held out and have a language and a text.

    Weights are fitted to at most ``sample`` of them, as many of each language as there
    are or as a language's part of ``sample`` allows; where there are more languages than
    that, the rarest are not learnt.
    """
    teach = documents.where("lang is not null and text is not null").where(~held_out())
    found = map_texts(teach.select("text"), _frequency, "feature long, documents long").groupBy("feature").agg(F.sum("documents").alias("documents")).toArrow()
    feature, documents_ = found.column("feature").to_numpy(), found.column("documents").to_numpy()
    n = int(documents_[feature == -1].sum())
    df = np.zeros(DIM)
    df[feature[feature >= 0]] = documents_[feature >= 0]
    idf = np.log((n + 1) / (df + 1)) + 1
    # of each language alike, so that rare ones are learnt
    per = {r[0]: r[1] for r in teach.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    langs = sorted(per)
    if not langs:
        return Model([UNKNOWN], np.zeros((DIM, 1)), np.zeros(1), 1.0)
    most = sample // len(langs)
    bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share(most, per[lang]))])
    rows = teach.select("text", "lang", draw("doc_id", "text").alias("key")).where(F.col("key") < bound[F.col("lang")])  # null, so no row, where a language is not learnt
    # a little over ``most`` rows of each language are left to rank
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= most)
    rows = Scratch(documents.sparkSession, "language").save(map_texts(rows.select("text", "lang", "key"), _training, "features binary, counts binary, size long, lang string, key long"), "features")
    table = within(rows, most_features).orderBy("key", "lang").toArrow()
    data = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(table.column("features").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    labels = np.array([langs.index(x) for x in table.column("lang").to_pylist()], int)
    ok = np.array([len(a) > 0 for a, _ in data], bool)
    data, labels = [d for d, k in zip(data, ok, strict=True) if k], labels[ok]
    if not len(labels):
        return Model(langs, np.zeros((DIM, len(langs))), np.zeros(len(langs)), 1.0)
    aside = np.arange(len(labels)) % 5 == 4
    weights, bias = fit([d for d, a in zip(data, aside, strict=True) if not a], labels[~aside], len(langs), idf)
    logits = np.array([(weights[at] * count[:, None]).sum(0) / count.sum() + bias for (at, count), a in zip(data, aside, strict=True) if a]).reshape(-1, len(langs))
    return Model(langs, weights.astype(np.float32), bias, calibrate(logits, labels[aside]))


def _predict(batches, model):
    m = model.value
    for batch in batches:
        for part in slices(batch):
            grams = Grams(part.column("text"))
            p = softmax(m.logits(grams) / m.temperature)
            best = p.argmax(1)
            known = grams.letters > 0
            lang = np.where(known, np.array(m.langs, object)[best], UNKNOWN)
            score = np.where(known, np.round(p[np.arange(len(p)), best], 9), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict_language(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, lang_pred and score, its calibrated probability.

    Learns from ``documents`` (doc_id, text, lang) unless a ``model`` is given: from rows
    with a language whose crc32 of the id is no multiple of 5.  A text that is null or
    has no letter is ``und`` with score 0.  Rows that repeat an id or a text, and null
    ids, are predicted each.  Where no row teaches, all are ``und``.  Ties go to the
    language that sorts first.  Whole texts count; other columns are never read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))  # of fixed size
    found = map_texts(documents.select("doc_id", "text"), partial(_predict, model=shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
