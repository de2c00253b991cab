"""Session helpers: where lineage may be cut, and what is small enough to broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temp folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written between the rounds of an iterative job, so that each round starts from files, not from lineage.

    Files survive the loss of any executor.  ``keep`` generations of a name stay; older ones are removed.
    """

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep = spark, keep
        self.root = f"{scratch_root(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
        self.written: dict[str, list[str]] = {}
        self.count = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{name}-{self.count}"
        self.count += 1
        df.write.parquet(path)
        generations = self.written.setdefault(name, [])
        generations.append(path)
        while len(generations) > self.keep:
            self._remove(generations.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables of these names; only for those that no later job reads."""
        for name in names:
            for path in self.written.pop(name, []):
                self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, by_file: bool = False) -> DataFrame:
    """Give CPU-heavy per-row work all cores when the input is a handful of files.

    Only inputs with fewer splits than the cluster has cores are redistributed, so a large table is never shuffled here.  A file may
    hold fewer row groups than it has splits, and then most splits are empty: ``by_file`` counts files, for tables of short rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = len(df.inputFiles()) if by_file else df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < cores else df


def small_table(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a rule-like table for broadcast once its row count is shown to be within ``max_rows``.

    Counting stops at ``max_rows + 1`` rows.  Larger tables come back unhinted, so joins fall to a shuffle.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df
