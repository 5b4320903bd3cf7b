"""Quality rules: counts of a text's words, lines and repeats, and tokeniser fertility.

Fertility asks how a public vocabulary takes a whole text, white space included:
characters per token, the share of tokens that are bytes the vocabulary has no piece
for, and the entropy of the tokens.  Each measure has a band per language, where the
row names one that has bands, else per script; a text outside a band is rejected.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import SPACE, U64, Words, mix, map_texts, slices, words_of
from .tokens import Units, WordIds, word_ids

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
REPEAT_WINDOW = 5
#: Numbers of tokens at which floors change: measures rise and fall with a text's length.
SIZES = (50, 100, 200, 400, 800, 1600, 3200)
#: Bands by language or script: most characters per token, most byte share, and by size the
#: least characters per token and the least entropy (bits per token over those of FULL or,
#: if fewer, as many different tokens).  Floors of languages lie under the least of the
#: documents labelled good on sf 0.1 and check_s whose crc32 of the id is no multiple of 5,
#: by 0.03 and 0.005, and by 0.15 and 0.03 below 100 tokens.  Fixed values.
BANDS = {
    "en": (12.0, 0.10, (1.77, 1.49, 1.84, 2.15, 2.25, 2.38, 2.49, 2.53), (0.793, 0.752, 0.765, 0.717, 0.674, 0.649, 0.667, 0.683)),
    "de": (12.0, 0.10, (1.99, 1.41, 2.15, 2.22, 2.31, 2.43, 2.49, 2.54), (0.799, 0.773, 0.763, 0.713, 0.661, 0.641, 0.652, 0.665)),
    "es": (12.0, 0.10, (1.77, 1.39, 1.98, 2.00, 2.10, 2.16, 2.21, 2.23), (0.814, 0.774, 0.760, 0.710, 0.662, 0.637, 0.654, 0.666)),
    "fr": (12.0, 0.10, (1.85, 1.36, 1.74, 1.97, 2.13, 2.23, 2.26, 2.29), (0.850, 0.773, 0.759, 0.700, 0.645, 0.629, 0.644, 0.657)),
    "latin": (12.0, 0.20, (1.30, 1.30, 1.50, 1.70, 1.80, 1.90, 2.00, 2.00), (0.780, 0.740, 0.740, 0.690, 0.640, 0.620, 0.640, 0.650)),
    "cyrillic": (12.0, 0.20, (0.8,) * 8, (0.50,) * 8),
    "cjk": (4.0, 0.60, (0.3,) * 8, (0.45,) * 8),
    "other": (12.0, 0.90, (0.2,) * 8, (0.40,) * 8),
}
SCRIPTS = ("latin", "cyrillic", "cjk", "other")
_NAMES = tuple(BANDS)
_HIGH, _BYTES = np.array([b[0] for b in BANDS.values()]), np.array([b[1] for b in BANDS.values()])
_LOW, _ENTROPY = np.array([b[2] for b in BANDS.values()]), np.array([b[3] for b in BANDS.values()])
#: Different tokens beyond which more do not count against a text's entropy.
FULL = 1024


def counts(words: Words) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, offsets, n = words.data, words.offsets, words.n
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    out = {"n_words": words.count.astype(np.int64), "word_chars": per(~SPACE[data] & (data & 0xC0 != 0x80)), "n_symbols": per(_SYMBOL[data])}
    stops = np.append(np.flatnonzero(data == 0x0A), len(data))
    starts = np.union1d(stops[:-1] + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(stops[np.searchsorted(stops, starts)], offsets[doc + 1])
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    key = words.hashes(starts, ends) ^ mix(doc.astype(U64))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=n)[:n] - np.bincount(doc[first], minlength=n)[:n]
    at, hashed = words.windows(REPEAT_WINDOW)
    _, inverse, times = np.unique(hashed ^ mix(words.doc[at].astype(U64)), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1] if len(at) else at
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first])
    return {k: v.astype(np.int64) for k, v in out.items()}


def script(words: Words) -> np.ndarray:
    """Per text the index in SCRIPTS of the script that most of its letters begin with."""
    kind = np.full(256, -1, np.int8)
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xC9)]] = 0
    kind[0xD0:0xD4] = 1
    kind[0xE3:0xEE] = 2
    kind[[*range(0xCA, 0xD0), *range(0xD4, 0xE3), *range(0xF0, 0xF5)]] = 3
    own = kind[words.data]
    per = [np.diff(np.concatenate(([0], np.cumsum(own == k)))[words.offsets]) for k in range(len(SCRIPTS))]
    return np.argmax(np.array(per), axis=0)


def fertility(units: Units, ids: np.ndarray, size: np.ndarray, is_byte: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_tokens, chars_per_token, byte_share and entropy, null where there are no tokens."""
    ends = np.concatenate(([0], np.cumsum(size)))[units.first]
    total = np.diff(ends)
    chars = np.diff(np.concatenate(([0], np.cumsum(units.data & 0xC0 != 0x80)))[units.offsets])
    byte = np.diff(np.concatenate(([0], np.cumsum(is_byte[ids])))[ends])
    doc = np.repeat(np.arange(units.n), total)
    key = np.sort(doc.astype(np.int64) * (1 << 32) + ids)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    times = np.diff(np.concatenate((first, [len(key)])))
    whose = key[first] >> 32
    surprise = np.bincount(whose, weights=times * np.log2(times), minlength=units.n)[: units.n] if len(key) else np.zeros(units.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = (np.log2(total) - surprise / total) / np.log2(np.minimum(total, FULL))
        return {"n_tokens": total, "chars_per_token": chars / total, "byte_share": byte / total, "entropy": np.where(total > 1, entropy, np.nan)}


def passes(band: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    """Whether measures lie inside the bands with the given places in BANDS."""
    size = np.digitize(f["n_tokens"], SIZES)
    fits = (f["chars_per_token"] >= _LOW[band, size]) & (f["chars_per_token"] <= _HIGH[band])
    return fits & (f["byte_share"] <= _BYTES[band]) & (f["entropy"] >= _ENTROPY[band, size])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, band string, n_tokens long, chars_per_token double, byte_share double, entropy double"


def measure(part: pa.RecordBatch, encode: WordIds, is_byte: np.ndarray) -> dict[str, pa.Array]:
    """All columns of SCHEMA for the texts of a batch; ``lang`` names bands where the batch has it."""
    words, units = words_of(part.column("text")), Units(part.column("text"), encode.alone)
    out = counts(words)
    failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    f = fertility(units, *encode(units), is_byte)
    band = np.array([_NAMES.index(x) for x in SCRIPTS])[script(words)]
    if "lang" in part.schema.names:
        own = [_NAMES.index(x) if x in BANDS and x not in SCRIPTS else -1 for x in part.column("lang").to_pylist()]
        band = np.where(np.array(own) >= 0, own, band)
    found = {**out, "base_failed": failed, "kept": ~failed & passes(band, f), "band": np.array(_NAMES, object)[band], **f}
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return {k: pa.array(found[k], arrow[t], from_pandas=True) for k, t in kinds.items()}


@cache
def _byte_pieces(path: str) -> np.ndarray:
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([loaded.IsByte(i) or loaded.IsUnknown(i) for i in range(len(loaded))])


def _work(batches, path: str, keep_only: bool):
    encode, is_byte = word_ids("pieces", path), _byte_pieces(path)
    for batch in batches:
        for part in slices(batch):
            found = measure(part, encode, is_byte)
            if keep_only:
                yield part.filter(found["kept"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.values()], names=["doc_id", *found])


def rate_quality(documents: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``documents``: doc_id, the base counts, base_failed, kept, band and the fertility measures.

    Words are runs of characters but white space (space, U+0009 to U+000D).  base_failed
    is n_words < 10 or 100 * n_repeat_words > 20 * n_words.  kept is false if it is, and
    else whether the fertility is inside the bands of the row's ``lang``, if the table
    has that column of strings and the language has bands, or else of its script.  A null
    text counts as empty (no words, so it fails); measures without tokens are null.  Texts
    are measured whole, however long.  Rows that repeat an id or a text, and null ids,
    are rated each.  No rows give none, and other columns are ignored.
    """
    return map_texts(documents.select("doc_id", "text", *_lang(documents)), partial(_work, path=model_path, keep_only=False), f"doc_id long, {SCHEMA}", vocabulary=True)


def _lang(documents: DataFrame) -> list[str]:
    return [c for c, t in documents.dtypes if c == "lang" and t == "string"]


def keep_good(documents: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``documents`` that ``rate_quality`` keeps, with all their columns."""
    return map_texts(documents, partial(_work, path=model_path, keep_only=True), documents.schema, vocabulary=True)
