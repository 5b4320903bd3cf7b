"""Mixing sources to target weights by repetition rates, in DataFrame operations alone.

Sizes are summed per source, targets are filled like connected vessels (a source that
reaches its ceiling stops, and the rest share what it leaves by weight), and each
document is taken floor(rate) times, and once more if a number hashed from its id is
below the rate's fraction.  No sort, window or shuffle by source holds documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = "mix"
#: Sources whose rates may be broadcast; beyond it, rates join by salted shuffles.
MOST_BROADCAST = 50_000
SALTS = 32


def with_size(documents: DataFrame) -> DataFrame:
    return documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_rates(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    per = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "per-source")
    # ranks by code point over any number of sources: within ranges, plus what the ranges before hold
    parts = per.repartitionByRange(8, F.col("source").isNull(), "source") if per.count() > MOST_BROADCAST else per.coalesce(1)
    parts = scratch.save(parts.withColumn("part", F.spark_partition_id()), "ranges")
    from pyspark.sql import Window as W

    counts = parts.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = scratch.save(parts.join(F.broadcast(counts), "part").select("source", "source_size", weight.cast("long").alias("weight")), "ranked")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    full, held, open_weight, level = [], 0, -1, 0.0
    while True:  # each round stops sources for good, so it ends
        stop = F.lit(False) if not full else F.lit(float(most)) * F.col("source_size") < F.lit(full[-1]) * F.col("weight")
        row = ranked.agg(F.coalesce(F.sum(F.when(stop, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~stop, F.col("weight"))), F.lit(0))).first()
        if (row[0], row[1]) == (held, open_weight) or not row[1]:
            break
        held, open_weight = row[0], row[1]
        level = (total - held) / open_weight
        full.append(level)
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES, seed: str = SEED) -> DataFrame:
    """``documents`` with size, source_size, target and copies (how often the mix takes each).

    Size counts runs of characters but white space; a null text has none.  Sources
    are ordered by code point, null last (null is a source of its own), and weigh
    ``weights`` in turn.  Targets share all words by weight, but none is above
    ``most`` times its source's size.  A source without words has target 0 and takes
    nothing.  Draws hash the id, so reruns agree; rows that repeat an id draw alike,
    and a null id draws as the text "null".  No rows give no rows.  Columns named like
    the four new ones are replaced.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    bare = documents.drop("size", "source_size", "target", "copies")
    rates = source_rates(with_size(documents.select("source", "text")).select("source", "size"), scratch, weights, most)
    return _apply(with_size(bare), rates, seed)


def _apply(sized: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    rates = rates.withColumnRenamed("source", "__mix_source")
    if rates.count() <= MOST_BROADCAST:
        joined = sized.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("__mix_source")))
    else:
        salted = sized.withColumn("__mix_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        each = rates.withColumn("__mix_each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(each, F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_salt") == F.col("__mix_each"))).drop("__mix_salt", "__mix_each")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("__mix_source")


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it takes it."""
    return mixed.where("copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__mix_copy")
