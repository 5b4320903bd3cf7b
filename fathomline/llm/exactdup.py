"""Exact duplicates by progressive refinement, in DataFrame operations alone.

Texts are told apart by their length, then by a hash of their beginning, then by a hash
of the whole.  What a step leaves alone is done with: lengths, and lengths with
beginnings, that several rows share become bits of a map of fixed size, and a text
whose bit is not set is not read to its end.  Two keys may meet in a bit; then more is
read than need be, and nothing is decided by it.

Texts never cross the network.  Groups hold a third of all rows at times: they are
counted before they are shuffled, the few large ones are broadcast (there are at most
``HOT`` with more than one HOT-th of the rows), and the others are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

#: Characters of a text's beginning that are hashed.
PREFIX = 64
#: Words of 64 bits in a map of keys that several rows share: 2**26 bits, at most 1,048,576 rows of
#: two numbers to broadcast.  The fuller it is, the more texts are read that need not be.
MAP_WORDS = 1 << 20
#: A group with more than one of HOT of the rows is hot.
HOT = 10_000


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """(word, bits): the map of those keys that two rows or more have."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(_place(*keys)).select("at.*").groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _place(*keys: str) -> Column:
    """A key's word and bit in a map."""
    h = F.pmod(F.xxhash64(*keys), F.lit(MAP_WORDS * 64))
    return F.struct(F.shiftrightunsigned(h, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("bit")).alias("at")


def _marked(rows: DataFrame, shared: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with whether the map has their key's bit."""
    placed = rows.select("*", _place(*keys)).join(F.broadcast(shared), F.col("at.word") == F.col("word"), "left")
    return placed.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(F.col("at.bit")) != 0, F.lit(False))).drop("at", "word", "bits")


def exact_duplicates(documents: DataFrame, prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept), a row for each of ``documents`` (doc_id, text).

    Texts are equal when their bytes are; a null text is an empty one, and empty texts
    equal each other.  Of equal texts one row stays, one with the largest doc_id, null
    being less than any; of rows that repeat that id and text, exactly one is kept.
    Long texts are hashed whole.  With ``digest`` each row also has ``text_sha256``, for
    which the texts that nothing shares are read to their end after all.  No rows give no
    rows; other columns, whatever their names, are ignored.
    """
    scratch = Scratch(documents.sparkSession, "exactdup")
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.select("*", F.octet_length("text").cast("long").alias("size"), F.xxhash64(F.substring("text", 1, prefix)).alias("head"))

    narrow = scratch.save(keyed.select("size", "head"), "lengths")
    lengths = scratch.save(_shared(narrow, "size"), "shared-lengths")
    heads = scratch.save(_shared(_marked(narrow, lengths, "open", "size").where("open"), "size", "head"), "shared-heads")
    scratch.drop(narrow)

    full = F.unhex(F.sha2("text", 256))
    read = _marked(_marked(keyed, lengths, "by_size", "size"), heads, "by_head", "size", "head")
    open_ = F.col("by_size") & F.col("by_head")
    columns = ["doc_id", F.when(open_, F.col("size")).alias("size"), F.when(open_, full).alias("full")]
    if digest:
        columns += [F.when(~open_, full).alias("other")]
    rows = scratch.save(read.select(*columns).withColumn("row", F.monotonically_increasing_id()), "hashed")

    first = F.max(F.struct("doc_id", "row"))
    groups = rows.where("full is not null").groupBy("full", "size").agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1")
    groups = scratch.save(groups.select(F.col("full").alias("g_full"), F.col("size").alias("g_size"), "group_size", "first"), "groups")
    bound = max(rows.count() // HOT, 1)
    hot, cold = groups.where(F.col("group_size") > bound), groups.where(F.col("group_size") <= bound)
    same = (F.col("full") == F.col("g_full")) & (F.col("size") == F.col("g_size"))
    by_hot = rows.join(F.broadcast(hot), same, "left")
    done = F.col("g_full").isNotNull() | F.col("full").isNull()
    rest = by_hot.where(~done).select(*rows.columns).join(cold, same, "left")
    out = by_hot.where(done).unionByName(rest)
    own = F.col("group_size").isNotNull()
    return out.select(
        "doc_id",
        F.when(own, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(own, F.col("first.row") == F.col("row")).otherwise(F.lit(True)).alias("kept"),
        *([F.lower(F.hex(F.coalesce("full", "other"))).alias("text_sha256")] if digest else []),
    )
