"""Toxicity: a sparse logistic regression on words, with counterfactual regularisation.

Sentences that name a group are also read with the group's term swapped for another
of its kind, and a change of score is penalised, so that the name alone raises none.
The weights are fitted by follow-the-regularised-leader, whose first-order penalty
leaves only words that matter.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .holdout import bounded, held_out, within
from .textkernel import U64, Words, mix, map_texts, slices, words_of

BITS = 18
PREFIXES = (4, 5, 6)
#: Labelled documents that the classifier is fitted to at most, those with the least draws.
SAMPLE = 20_000
#: Features (4 bytes each) that these have in all, or up to 2 ** BITS more: of documents
#: beyond it, those with the largest draws teach nothing.
MOST_FEATURES = 1 << 24
EPOCHS = 4
#: Weight of the squared change of score under a swap.
COUNTERFACTUAL = 1.0
#: Identity terms that are swapped within their kind.  Fixed values.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_features(words: Words, shared: bool = False) -> list[np.ndarray]:
    """Per text the distinct feature numbers of its words, without signs at either end, and
    of their beginnings of each of PREFIXES bytes, which inflected words share.  With
    ``shared`` only those that several different words of the text have."""
    solid = _ALNUM[words.data]
    at = np.flatnonzero(solid)
    if len(at):
        start = at[np.minimum(np.searchsorted(at, words.start), len(at) - 1)]
        end = at[np.maximum(np.searchsorted(at, words.end) - 1, 0)] + 1
        real = (start >= words.start) & (end <= words.end) & (start < end)
    else:
        start, end, real = words.start, words.end, np.zeros(len(words.start), bool)
    start, end, doc = start[real], end[real], words.doc[real].astype(np.int64)
    if shared:
        _, one = np.unique(np.stack([doc.astype(U64), words.hashes(start, end)]), axis=1, return_index=True)
        start, end, doc = start[one], end[one], doc[one]
    keys = []
    for n in (0, *PREFIXES):
        own = end - start > n
        h = words.hashes(start[own], start[own] + n if n else end[own])
        keys.append(doc[own] << BITS | (mix(h + U64(n)) & U64((1 << BITS) - 1)).astype(np.int64))
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    key = key[times > 1] if shared else key
    edge = np.searchsorted(key >> BITS, np.arange(words.n + 1))
    low = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [low[edge[i] : edge[i + 1]] for i in range(words.n)]


def _feature(term: str) -> int:
    words = words_of(pa.array([term]))
    return int(mix(words.hashes(words.start, words.end))[0] & U64((1 << BITS) - 1))


def _kinds() -> dict[int, list[int]]:
    """By the feature of each term those of its kind."""
    kinds = [[_feature(t) for t in kind] for kind in IDENTITY]
    return {f: kind for kind in kinds for f in kind}


class Ftrl:
    """Weights by follow-the-regularised-leader with elastic-net penalties."""

    def __init__(self, shape, alpha=0.3, beta=1.0, first=10.0, second=1.0):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.first, self.second = alpha, beta, first, second

    def at(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.first) / ((self.beta + np.sqrt(n)) / self.alpha + self.second)
        return np.where(np.abs(z) <= self.first, 0.0, w)

    def learn(self, rows, w, g):
        """Takes gradients g at distinct ``rows``, whose weights are w."""
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, penalty: float = COUNTERFACTUAL, shared: list[np.ndarray | None] | None = None) -> np.ndarray:
    """Weights by feature, the last the bias.  ``shared`` has those features of each row that
    stay if one of its words is swapped, as other words have them too; rows that name no term
    need none."""
    bias = 1 << BITS
    of = _kinds()
    terms = [t for kind in IDENTITY for t in kind]
    whole = dict(zip((_feature(t) for t in terms), word_features(words_of(pa.array(terms))), strict=True))
    model = Ftrl(bias + 1)
    draw = np.random.default_rng(11)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)).clip(0.2, 20) if len(labels) else labels
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            x = np.append(rows[i], bias)
            w = model.at(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = np.full(len(x), (p - labels[i]) * balance[i])
            named = [f for f in rows[i].tolist() if f in of] if penalty else []
            model.learn(x, w, g)
            for f in named:
                other = int(draw.choice([o for o in of[f] if o != f]))
                # the swapped sentence: without what only the term has, with what the other brings
                gone = np.setdiff1d(whole[f], shared[i]) if shared else whole[f]
                gone = np.setdiff1d(gone, whole[other])
                new = np.setdiff1d(whole[other], rows[i])
                swap = np.concatenate((gone, new))
                sign = np.where(np.arange(len(swap)) < len(gone), 1.0, -1.0)
                w = model.at(swap)
                score, change = model.at(x).sum(), (sign * w).sum()
                p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                q = 1 / (1 + np.exp(-np.clip(score - change, -30, 30)))
                # of penalty * (p - q) ** 2, by the weights that differ
                d = 2 * penalty * (p - q)
                model.learn(swap, w, np.where(sign > 0, d * p * (1 - p), -d * q * (1 - q)) + sign * penalty * change)
    return model.at(np.arange(bias + 1))


def _training(batches):
    terms = np.array(sorted(_kinds()), np.int32)
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), lower=True)
            found = word_features(words)
            shared = [s.tobytes() if np.isin(f, terms).any() else None for f, s in zip(found, word_features(words, True), strict=True)]
            size = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary()), pa.array(shared, pa.binary()), size, part.column("toxic"), part.column("key")], names=["features", "shared", "size", "toxic", "key"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> np.ndarray:
    """Weights fitted to at most ``sample`` labelled documents that are not held out."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    # the sample is chosen by ids alone, so that few texts meet their labels
    own = bounded(own.where(~held_out()), sample, "doc_id").drop("key")
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    picked = texts.join(F.broadcast(own), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("key"))
    rows = Scratch(documents.sparkSession, "toxicity").save(map_texts(picked, _training, "features binary, shared binary, size long, toxic long, key long"), "features")
    table = within(rows, most_features).orderBy("key", "features").toArrow()
    rows, shared = ([f if f is None else np.frombuffer(f, np.int32) for f in table.column(c).to_pylist()] for c in ("features", "shared"))
    return fit(rows, table.column("toxic").to_numpy().clip(0, 1), shared=shared)


def _score(batches, weights):
    w = weights.value
    for batch in batches:
        for part in slices(batch):
            found = word_features(words_of(part.column("text"), lower=True))
            flat = np.concatenate([*found, np.zeros(0, np.int32)])
            run = np.concatenate(([0.0], np.cumsum(w[flat])))
            edge = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(int)
            p = 1 / (1 + np.exp(-np.clip(run[edge[1:]] - run[edge[:-1]] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p, 9))], names=["doc_id", "score"])


def score_toxicity(documents: DataFrame, labels: DataFrame | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score (0 to 1) and predicted (score >= 0.5).

    ``labels`` (doc_id, toxic 0/1) teach it where no ``weights`` are given; documents
    whose crc32 of the id is a multiple of 5 are held out.  A label repeated for an id
    counts as its largest; null labels teach nothing, and without labels all scores
    are 0.5 (and predicted 1 stays for that tie).  A null or empty text scores by the
    bias alone.  Rows that repeat an id or a text, and null ids, are scored each.
    Other columns are never read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels) if weights is None else weights)  # of fixed size
    found = map_texts(documents.select("doc_id", "text"), partial(_score, weights=shared), "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
