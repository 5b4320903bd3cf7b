"""How far the sources of a language diverge in their terms, ranked by radix selection.

Terms are counted within slices of text before anything is shuffled, then per language
and source.  A term's smoothed share p of a group is an integer, and the divergence of
two shares is f = floor((p - q)^2 / (p + q)).

Most of a language's terms do not occur in most of its sources, where all have the
group's base share.  So the sum of f over all terms for two sources is what their
histograms of shares have against each other's base share, less what both count twice,
plus a correction for the terms that both have: no row is made for an absent term.

The k best of a group are found by histograms over bits of the values, 16 at a time
from the highest: each round narrows a group to the bits that its k-th value has.
Values equal to it are told apart in the same way by their items' bytes, from the first
in which they differ.  Only the k best are sorted.
"""

from __future__ import annotations

import os.path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch
from .textkernel import LOWER, buffers, map_texts, slices

#: Documents of a language that a term has to occur in.
LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: Rows per group that may be broadcast; beyond it they are joined by salted shuffles.
MOST_BROADCAST = 50_000
SALTS = 32
BITS = 16
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes as terms have them: letters in lower case and bytes of other characters; 0 elsewhere.
_TERM = np.where(np.arange(256) >= 0x80, np.arange(256), 0).astype(np.uint8)
_TERM[0x41:0x5B] = LOWER[0x41:0x5B]
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts in order, and the text that each is of."""
    data = _TERM[data]
    solid = data != 0
    before = np.concatenate(([False], solid[:-1]))
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate((solid[1:], [False]))
    after[edge - 1] = False
    size = np.flatnonzero(solid & ~after) + 1 - start
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    return terms.dictionary_encode(), np.searchsorted(offsets, start, "right") - 1


def _count(batches):
    """(lang, source, term, occurrences, documents) of each slice of about 1 MB of text."""
    for batch in batches:
        for part in slices(batch):
            terms, doc = term_runs(*buffers(part.column("text")))
            if not len(terms):
                continue
            group = pd.MultiIndex.from_arrays([part.column("lang").to_pandas(), part.column("source").to_pandas()])
            code, names = pd.factorize(group)
            word, many = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
            once, n = np.unique(doc * many + word, return_counts=True)
            key, back, docs = np.unique(code[once // many] * many + once % many, return_inverse=True, return_counts=True)
            total = np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)
            own = pa.array(key // many)
            arrays = [*(pa.array(names.get_level_values(k).tolist(), pa.string()).take(own) for k in (0, 1)), terms.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(total), pa.array(docs.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (size + 2 * terms)), exact for any counts; 1 without terms."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")).alias("a")
    return F.when(terms > 0, 1 + F.call_function("div", whole, (size + 2 * terms).cast("decimal(20,0)"))).otherwise(F.lit(1).cast("long"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _per_group(rows: DataFrame, table: DataFrame, *keys: str, many: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has few rows for each key: broadcast if it
    is small, else joined with the rows of a key in SALTS parts."""
    if (table.count() if many is None else many) <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), list(keys))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    each = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [*keys, "__salt"]).drop("__salt")


def _narrow(scratch: Scratch, counted: DataFrame, group: str, place: Column, label: str) -> DataFrame:
    """The place in whose rows each group's ``need``-th row lies, from (group, need, place) rows:
    (group, need within it, place, whether all of it are needed).  Of groups with fewer rows: none."""
    size = counted.groupBy(group, "need", place.alias("place")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(group).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = size.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("c")))
    left = F.col("need") - F.col("before")
    return scratch.save(found.select(group, left.alias("need"), "place", (left == F.col("c")).alias("all")), label)


def radix_top(rows: DataFrame, group: str, value: str, item: str, k: int, scratch: Scratch) -> DataFrame:
    """``rows`` (materialised) that are among the first k of their group by ``value`` (a long
    from 0) descending, then ``item`` (differing within a group) by UTF-8 bytes ascending.

    No group is sorted or lies in one task: a round counts rows by BITS bits of their
    values, then by two bytes of their items.
    """
    high = rows.agg(F.max(value)).first()[0]
    if high is None:
        return rows
    groups = scratch.save(rows.select(group).distinct(), "groups")
    many = groups.count()
    top = -(-max(int(high).bit_length(), 1) // BITS) * BITS
    state = groups.select(group, F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("prefix"))
    bounds = []  # (group, least value that is in for sure)
    for shift in range(top - BITS, -1, -BITS):
        bits = F.shiftright(value, shift)
        own = _per_group(rows, state, group, many=many).where(F.shiftright(value, shift + BITS) == F.col("prefix") if shift + BITS < 64 else F.lit(True))
        # the largest bits come first
        found = _narrow(scratch, own, group, -bits, f"bits{shift}")
        bounds.append(found.where("all").select(group, F.shiftleft(-F.col("place"), shift).alias("bound")))
        state = found.where("not all").select(group, "need", (-F.col("place")).alias("prefix"))
    open_ = scratch.save(state, "ties")
    bounds.append(open_.select(group, (F.col("prefix") + 1).alias("bound")))
    known = bounds[0]
    for b in bounds[1:]:
        known = known.union(b)
    known = scratch.save(groups.join(known, group, "left").select(group, F.coalesce("bound", F.lit(0)).alias("bound")), "bounds")
    sure = _per_group(rows, known, group, many=many).where(F.col(value) >= F.col("bound")).select(rows.columns)
    return sure.union(_ties(rows, open_, group, value, item, scratch).select(rows.columns))


def _ties(rows: DataFrame, open_: DataFrame, group: str, value: str, item: str, scratch: Scratch) -> DataFrame:
    """Of each group's rows with the value ``prefix`` the first ``need`` by the bytes of their items."""
    tied = _per_group(rows, open_.withColumnRenamed("prefix", "__tied"), group).where(F.col(value) == F.col("__tied")).drop("__tied")
    tied, taken, n = scratch.save(tied, "tied"), [], 0
    while not tied.isEmpty():
        n += 1
        ends = tied.groupBy(group).agg(F.min(item).alias("low"), F.max(item).alias("high"))
        same = scratch.save(ends.mapInPandas(lambda frames: (_common(f, group) for f in frames), f"{tied.select(group).schema.simpleString()[7:-1].replace(':', ' ')}, skip int"), f"same{n}")
        # an item that ends there is less than any that goes on; a byte more than 0 goes before each
        two = F.substring(F.encode(item, "utf-8"), F.col("skip") + 1, F.lit(2))
        own = scratch.save(_per_group(tied, same, group).withColumn("bytes", F.rpad(F.hex(two), 4, " ")).drop("skip"), f"bytes{n}")
        scratch.drop(tied)
        found = _narrow(scratch, own, group, F.col("bytes"), f"place{n}")
        met = _per_group(own.drop("need"), found, group)
        first = met.where((F.col("bytes") < F.col("place")) | (F.col("all") & (F.col("bytes") == F.col("place"))))
        taken.append(first.select(rows.columns))
        tied = scratch.save(met.where(~F.col("all") & (F.col("bytes") == F.col("place"))).select(*rows.columns, "need"), f"tied{n}")
    out = rows.limit(0)
    for t in taken:
        out = out.union(t)
    return out


def _common(frame: pd.DataFrame, group: str) -> pd.DataFrame:
    """How many bytes all of a group's items begin with: those that the least and the largest do."""
    skip = [len(os.path.commonprefix([a.encode(), b.encode()])) for a, b in zip(frame["low"], frame["high"], strict=True)]
    return pd.DataFrame({group: frame[group], "skip": pd.array(skip, "int32")})


def term_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs, lang_n) of the kept terms with n > 0, and all (lang, source)."""
    scratch = Scratch(documents.sparkSession, "terms")
    plain = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = map_texts(plain, _count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")  # a row per source
    counted = counted.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    counted = counted.withColumn("lead", F.col("source") == F.min("source").over(of_term)).where(F.col("lang_docs") >= least)
    return scratch.save(counted.drop("lang_docs"), "terms"), scratch.save(plain.select("lang", "source").distinct(), "groups")


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources differ, and by which terms.

    Null text, lang and source of ``documents`` are empty ones.  Terms are runs of letters
    A to Z, in lower case, and of characters beyond U+007F; those that occur in ``least``
    documents of their language are kept, however long.  Part ``pair`` has for each source
    its language's others and the sum of f over all kept terms (0 without any), all ranks;
    part ``term`` has those kept terms of a source whose share is above the language's,
    the first ``top`` by f.  Ties go to the item with less UTF-8 bytes.  A document counts
    as often as it is there; a language of one source has no pairs, and no rows give none.
    Other columns, whatever their names, are ignored.
    """
    scratch = Scratch(documents.sparkSession, "divergence")
    terms, present = term_counts(documents, least)
    langs = terms.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum("n").alias("lang_size"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("has"))
    groups = present.join(own, ["lang", "source"], "left").join(F.broadcast(langs) if langs.count() <= MOST_BROADCAST else langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("base", share(F.lit(0), F.col("size"), F.col("terms"))).withColumn("id", F.monotonically_increasing_id())
    groups = scratch.save(groups, "groups")
    shared = _per_group(terms, groups, "lang", "source")
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("lang_n"), F.col("lang_size"), F.col("terms"))
    shared = scratch.save(shared.select("lang", "id", "term", "base", p.alias("p"), q.alias("q")), "shares")

    over = scratch.save(shared.where("p > q").select("id", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "over")
    best = radix_top(over, "id", "value", "item", top, scratch)
    ranked = best.withColumn("part", F.lit("term")).unionByName(_pairs(shared, groups, scratch).withColumn("part", F.lit("pair")))
    rank = F.row_number().over(W.partitionBy("id", "part").orderBy(F.desc("value"), "item")).cast("int")
    return _per_group(ranked.withColumn("rank", rank), groups.select("id", "lang", "source"), "id").select("lang", "source", "part", "item", "value", "rank")


def _pairs(shared: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, item, value) for each two sources of a language, both ways."""
    # a source's shares with how many terms have them, absent terms with its base share
    absent = groups.select("lang", "id", "base", F.col("base").alias("p"), (F.col("terms") - F.col("has")).alias("m"), F.col("terms").alias("twice"))
    present = shared.groupBy("lang", "id", "base", "p").agg(F.count("*").alias("m")).withColumn("twice", F.lit(0).cast("long"))
    other = groups.select("lang", F.col("id").alias("o_id"), F.col("base").alias("o_base"))
    each = _per_group(absent.union(present), other, "lang").where("id <> o_id")
    # f of the two base shares, once for all terms, is in both directions' sums
    less = F.when(F.col("id") < F.col("o_id"), F.col("twice") * apart(F.col("base"), F.col("o_base"))).otherwise(0)
    two = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    sums = each.groupBy(*two("id", "o_id")).agg(F.sum(F.col("m") * apart(F.col("p"), F.col("o_base")) - less).alias("value"))
    l, r = shared.alias("l"), shared.alias("r")
    both = l.join(r, (F.col("l.lang") == F.col("r.lang")) & (F.col("l.term") == F.col("r.term")) & (F.col("l.id") < F.col("r.id")))
    lp, lb, rp, rb = (F.col(c) for c in ("l.p", "l.base", "r.p", "r.base"))
    more = apart(lp, rp) - apart(lp, rb) - apart(lb, rp) + apart(lb, rb)
    fixed = both.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b")).agg(F.sum(more).alias("value"))
    total = scratch.save(sums.union(fixed).groupBy("a", "b").agg(F.sum("value").alias("value")), "pairs")
    ways = total.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("w"), "value").select("w.*", "value")
    names = groups.select(F.col("id").alias("other"), F.col("source").alias("item"))
    return _per_group(ways, names, "other").select("id", "item", "value")
