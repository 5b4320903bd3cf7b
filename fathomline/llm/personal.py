"""Personal data: fixed patterns, and contextual extraction bootstrapped from them.

Matches of the fixed patterns are seed entities.  Instances are words with a digit or
an @, and runs of such words.  The words around them and their shape make lexical
patterns; a pattern is trusted by the share of its different instances that are known
entities, and an unknown instance by the trusted patterns it stands in.  Spark scores this graph of patterns and instances in rounds, and the
occurrences that trusted patterns bring in are added to the fixed matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch
from .textkernel import map_texts, slices, words_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.  Runs are possessive and begin where a run begins, so that no text
#: takes time quadratic in its length; matches are the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAY = (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9]([\x20-]?[0-9]){12}", r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds of scoring; a trusted pattern's least share of known instances, among them and
#: DOUBT more that are not, and least number of them; an accepted instance's least score.
ROUNDS = 3
TRUST, DOUBT, SUPPORT, ACCEPT = 0.9, 2.0, 5, 0.95
#: Candidates have a digit or @ in each word and at least so many letters and digits.
LEAST = 6
_ALNUM = re.compile(r"[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str, may=(True,) * 4) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns' matches, by kind and start."""
    out = []
    if may[0]:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((0, start, m.end()))
                last = m.end()
            at = text.find("@", max(at + 1, last))
    if may[1]:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := d.lstrip("0")) <= 3 and int(p or "0") <= 255 for d in m[0].split("."))]
    for kind, pattern, least, most in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        if may[kind]:
            for m in pattern.finditer(text):
                digits = [c for c in m[0] if "0" <= c <= "9"]
                if least <= len(digits) <= most and (kind == 3 or luhn("".join(digits))):
                    out.append((kind, m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Classes of characters in a row, each once, and a rough length."""
    out = []
    for c in token:
        k = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if not out or out[-1] != k:
            out.append(k)
    return f"{''.join(out)}{len(token) // 4}"


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64())), ("seed", pa.bool_())]))
SCHEMA = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,instance:long,patterns:array<long>,seed:boolean>>"


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts)) - (1 << 63)


def _candidates(words, i: int, raw: bytes, base: list, at: np.ndarray) -> list[dict]:
    """Words of text i (those ``at``), and runs of them parted by one space each, that may be
    identifiers, with the patterns they stand in."""
    lo, hi, shift = words.first[i], words.first[i + 1], int(words.offsets[i])
    joined = (np.diff(at) == 1) & (words.start[at[1:]] - words.end[at[:-1]] == 1) & (words.data[words.end[at[:-1]]] == 0x20)
    cut = np.flatnonzero(~joined) + 1
    runs = zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(at)])).tolist(), strict=True) if len(at) else ()
    out, chars, byte = [], 0, 0
    starts, ends = [], []  # of what the base spans cover
    for _, x, y in sorted(base, key=lambda s: s[1]):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    for a, b in runs:
        ranges = [(at[a], at[b - 1])] * (b - a > 1) + [(w, w) for w in at[a:b]]
        for first, last in ranges:
            begin = int(words.start[first]) - shift
            chars += len(raw[byte:begin].decode())
            byte = begin
            token = raw[begin : int(words.end[last]) - shift].decode()
            lead = len(token) - len(token.lstrip("\"'([{<*#$%&|!?.,;:"))
            core = token.strip("\"'()[]{}<>*#$%&|!?.,;:")
            if len(_ALNUM.findall(core)) < LEAST:
                continue
            start, end = chars + lead, chars + lead + len(core)
            near = [int(words.hash[n]) if lo <= n < hi else 0 for n in (first - 2, first - 1, last + 1, last + 2)]
            s = shape(core)
            patterns = [_hash("left", near[0], near[1], s), _hash("both", near[1], near[2], s), _hash("right", near[2], near[3], s), _hash("before", near[0], near[1]), _hash("around", near[1], near[2])]
            k = bisect_right(ends, start)
            seed = k < len(ends) and starts[k] < end
            out.append({"start": start, "end": end, "instance": _hash(core), "patterns": patterns, "seed": seed})
    return out


def _work(batches):
    row = TaskContext.get().partitionId() << 36
    digit = np.zeros(256, bool)
    digit[[*range(0x30, 0x3A), 0x40]] = True
    for batch in batches:
        for part in slices(batch):
            texts = part.column("text").fill_null("")
            may = np.array([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in MAY])
            words = words_of(texts, lower=True)
            run = np.concatenate(([0], np.cumsum(digit[words.data])))
            found = np.flatnonzero(run[words.end] - run[words.start] > 0)
            ends = np.searchsorted(found, words.first)
            base, cands = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
            for i in np.flatnonzero(may.any(0) | (np.diff(ends) > 0)).tolist():
                text = texts[i].as_py()
                base[i] = base_spans(text, may[:, i])
                cands[i] = _candidates(words, i, text.encode(), base[i], found[ends[i] : ends[i + 1]])
            count = [pa.array([sum(k == n for k, _, _ in b) for b in base], pa.int64()) for n in range(4)]
            named = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x] for x in base], _SPAN)
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, part.column("doc_id"), *count, named, pa.array(cands, _CAND)], names=["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "candidates"])


def bootstrap(occurrences: DataFrame, scratch: Scratch, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(pattern, instance) of trusted patterns and accepted instances, from (pattern, instance, seed)."""
    graph = scratch.save(occurrences.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    known = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    known = scratch.save(known.where("score > 0"), "known")
    seeds = known
    for _ in range(rounds):
        scored = graph.select("pattern", "instance").join(known, "instance", "left").na.fill(0.0, ["score"])
        trusted = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + DOUBT)).alias("trust"), F.sum(F.when(F.col("score") >= accept, 1).otherwise(0)).alias("hits"))
        trusted = scratch.save(trusted.where((F.col("trust") >= trust) & (F.col("hits") >= support)).select("pattern", "trust"), "trusted")
        doubt = F.sum(F.log1p(-F.least("trust", F.lit(0.999))))
        brought = graph.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= accept)
        known = scratch.save(brought.join(seeds, "instance", "left_anti").union(seeds), "known")
    return graph.join(trusted, "pattern").join(known, "instance").select("pattern", "instance").distinct()


def find_personal(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_spans and spans.

    Spans are (kind, start, end) in code points, end exclusive, by kind (email, ip,
    card, phone, context) and start; base_spans has the fixed patterns' matches, and
    spans adds those found by context, which overlap none of them.  A null or empty
    text has no spans.  Rows that repeat an id or a text, and null ids, are searched
    each.  Where nothing matches a fixed pattern there are no seeds and nothing is
    added.  Whole texts are read, however long; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "personal")
    rows = scratch.save(map_texts(documents.select("doc_id", "text"), _work, SCHEMA), "rows")
    each = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    each = scratch.save(each, "each")
    good = scratch.save(bootstrap(each.select("pattern", "instance", "seed"), scratch), "good")
    new = each.where("not seed").join(good, ["pattern", "instance"]).select("row", "start", "end").distinct()
    # of a run and its words, the run
    reached = F.max("end").over(W.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    new = new.withColumn("reached", reached).where("reached is null or end > reached")
    span = F.struct(F.lit("context").alias("kind"), "start", "end")
    extra = new.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("extra"))
    out = rows.drop("candidates").join(extra, "row", "left")
    spans = F.when(F.col("extra").isNull(), F.col("base_spans")).otherwise(F.concat("base_spans", "extra"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", spans.alias("spans"))
