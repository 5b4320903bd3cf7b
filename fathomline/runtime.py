"""Where intermediate tables go, and how a loop cuts lineage and statistics.

A fixpoint that stays lazy grows its plan each round, and checkpointed plans keep
their size estimates, which double in bit length with every join.  Writing a round
to Parquet and reading it again cuts both, and the files survive a lost executor.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests in one JVM) a temporary folder is
    made and kept for the session; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="fathomline-")
    return _local[app]


class Scratch:
    """Tables of one run under the shared folder.

    ``save`` materialises a dataframe and returns it as read back from the files.
    ``drop`` deletes one that nothing later reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        self.grown: dict[str, int] = {}
        self.saved: weakref.WeakSet[DataFrame] = weakref.WeakSet()

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.saved.add(out)
        return out

    def save_large(self, df: DataFrame, label: str) -> DataFrame:
        """``save`` for what grows with the input and packs well: files of a few MB may hold millions of rows,
        and would be broadcast, through the driver, for the size of the files."""
        return self.save(df, label).hint("merge")

    def held(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, materialised if it is not yet."""
        return df if df in self.saved else self.save(df, label)

    def grow(self, seen: DataFrame, new: DataFrame, label: str) -> DataFrame:
        """``seen`` and ``new``, both materialised, as one table; written anew every few rounds
        only, so that a round costs one write and plans stay short."""
        self.grown[label] = self.grown.get(label, 0) + 1
        both = seen.union(new)
        return self.save(both, label) if self.grown[label] % 8 == 0 else both

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
