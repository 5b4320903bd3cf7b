"""A training corpus from raw documents: quality, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a dataframe that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of docs, extra ones included, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.mixing import mix, repeat
from fathomline.llm.neardup import near_duplicates
from fathomline.llm.packing import pack
from fathomline.llm.quality import keep_good
from fathomline.llm.secrets import mask_secrets
from fathomline.runtime import Scratch

#: Ids of removed documents that may be broadcast (8 bytes each); beyond it the join shuffles.
MOST_BROADCAST = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the tokeniser's fertility accept.

    Rows are judged one by one: null, empty and short texts go, long ones are read whole,
    rows that repeat an id or a text share their text's fate, and a null id or any other
    null does not matter.
    """
    return keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Null and empty texts and rows with a null id are in no group and stay.  Of rows that
    repeat an id, one stays if any of its texts is kept: that with the least text, null
    first.
    """
    scratch = Scratch(spark, "gone")
    per = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    per = scratch.save(per.where("not kept or rows > 1"), "per")
    left = docs.join(_sized(per.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    again = per.where("kept")
    if again.isEmpty():
        return left
    row = F.struct(*docs.columns)
    least = docs.join(_sized(again.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
    return left.union(least.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _sized(ids: DataFrame) -> DataFrame:
    """Ids, broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret.

    Rows are masked one by one, those that repeat an id or a text alike; null and empty
    texts stay as they are, and long ones are scanned whole.  ``n_chars`` follows the
    text, null with it.
    """
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks.

    A null source is a source of its own; null and empty texts count no words and are
    taken at their source's rate, not at all in a source without words.  Rows that repeat
    an id draw alike, and a null id draws as the text "null".
    """
    return repeat(mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids.

    A null or empty text has its closing id alone; long ones are cut, never dropped; rows
    that repeat an id or a text and rows with a null id are packed each.
    """
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scans", secrets), ("source mixing", mixing), ("packing", packing)]

#: Tokenizers and a fitted field decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(before)
    return docs
