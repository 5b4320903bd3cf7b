"""What a classifier may learn from: the split of documents, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
_RANGE = 1 << 53


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def draw(*by: str) -> Column:
    """A number from 0 to 2**53, hashed from a row's columns."""
    return F.pmod(F.xxhash64(*by), F.lit(_RANGE))


def share(n: int, total: int) -> int:
    """The bound of draws below which a little over n of ``total`` rows lie (all, if there are few)."""
    return min(_RANGE, int(_RANGE * (1.2 * n + 50) / max(total, 1)))


def bounded(rows: DataFrame, n: int, *by: str, total: int | None = None) -> DataFrame:
    """The n rows with the least draws, with them in ``key``.

    Rows are thinned by their draws before they are sorted, so what is sorted has a
    little over n rows however many tasks there are.
    """
    total = rows.count() if total is None else total
    return rows.withColumn("key", draw(*by)).where(F.col("key") < share(n, total)).orderBy("key").limit(n)


def within(rows: DataFrame, most: int, size: str = "size", key: str = "key") -> DataFrame:
    """Those rows, in the order of ``key``, before which the sizes sum to less than ``most``.

    Only keys and sizes are sorted; rows of one key stay or go together.
    """
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("s").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = rows.groupBy(key).agg(F.sum(size).alias("s")).withColumn("before", before).where(F.col("before") < most).agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= F.lit(last)) if last is not None else rows.limit(0)
