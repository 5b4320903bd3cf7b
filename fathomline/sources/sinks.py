"""Exports: sorted JSON lines, their digests, checks of their shape, and generated C markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in the order of ``by`` over all files (ranges, not one sorted file)."""
    df.orderBy(*by).write.option("ignoreNullFields", "false").json(path)


def write_manifest(df: DataFrame, path: str, key: str) -> None:
    """One canonical record per key, arrays sorted; the commit of the write is atomic."""
    arrays = {c for c, t in df.dtypes if t.startswith("array")}
    df.select(*[F.array_sort(c).alias(c) if c in arrays else c for c in df.columns]).orderBy(key).write.mode("error").json(path)


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the number of rows and a digest of them in any order.

    Row hashes are added as 128-bit numbers, so no task sees all rows.
    """
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.sum(F.conv(F.substring(line, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", half(1).cast("string"), half(13).cast("string")).alias("digest"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): rows for which a rule's SQL condition is false or unknown."""
    counts = [F.sum(F.when(F.coalesce(F.expr(c), F.lit(False)), 0).otherwise(1)).alias(r) for r, c in rules.items()]
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).cast("long").alias("violations")) for r in rules])
    return df.agg(*counts).select(F.inline(pairs))


def marker_source(strategies: DataFrame, key: str, strategy: str) -> DataFrame:
    """(line): a C declaration per global that a strategy handles, in order of key."""
    text = F.concat(F.lit("extern const char marker_"), F.col(strategy), F.lit("_"), F.regexp_replace(F.col(key).cast("string"), "[^A-Za-z0-9_]", "_"), F.lit("[];"))
    return strategies.where(F.col(strategy) != "unhandled").orderBy(strategy, key).select(text.alias("line"))


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
