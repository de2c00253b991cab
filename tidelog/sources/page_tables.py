"""Tables of rows that belong to pages, stored in buckets of the page, so that a change rewrites only the buckets it touches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import Scratch

BUCKET = "_bucket"


class PageTables:
    """Parquet tables below ``root``, each partitioned by a hash of ``page_url`` into ``buckets``.

    A change is computed for the touched buckets alone, written aside first, and then put in place by a dynamic partition overwrite,
    so a job that is lost half way can run again.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64("page_url"), F.lit(self.buckets)).cast("int"))

    def create(self, table: str, rows: DataFrame) -> None:
        self._bucketed(rows).repartition(BUCKET, F.xxhash64(*rows.columns) % 8).write.mode("overwrite").partitionBy(BUCKET).parquet(self._path(table))
        # A table may be empty, and files without rows have no schema; it is kept beside them and makes the table exist.
        self.spark.createDataFrame([(rows.schema.json(),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{self._path(table)}.schema")

    def exists(self, table: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}.schema")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _stored(self, table: str) -> DataFrame:
        kept = StructType.fromJson(json.loads(self.spark.read.text(f"{self._path(table)}.schema").first()[0]))
        return self.spark.read.schema(kept.add(BUCKET, IntegerType())).parquet(self._path(table))

    def read(self, table: str) -> DataFrame:
        return self._stored(table).drop(BUCKET)

    def touched(self, pages: DataFrame) -> list[int]:
        """Buckets of ``pages``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self._bucketed(pages.select("page_url")).select(BUCKET).distinct().collect())

    def replace(self, table: str, pages: DataFrame, fresh: DataFrame | None = None, spare: DataFrame | None = None) -> dict[str, int]:
        """Rows of ``pages`` give way to those of ``fresh`` (to none without it); returns how many rows went and came.

        Rows of ``fresh`` that belong to other pages are ignored.  Rows that agree with one of ``spare`` in its columns stay.
        """
        pages = pages.select("page_url").distinct()
        touched = self.touched(pages)
        if not touched:
            return {"removed": 0, "added": 0}
        scratch = Scratch(self.spark, keep=4)
        if not self.exists(table):
            if fresh is None:
                return {"removed": 0, "added": 0}
            self.create(table, fresh.limit(0))
        old = self._stored(table).filter(F.col(BUCKET).isin(touched))
        rest = old.join(pages, "page_url", "left_anti")
        if spare is not None:
            rest = rest.unionByName(old.join(pages, "page_url", "left_semi").join(spare, spare.columns, "left_semi"), allowMissingColumns=False)
        new = rest.select(*old.columns)
        if fresh is not None:
            new = new.withColumn("_new", F.lit(False)).unionByName(self._bucketed(fresh.join(pages, "page_url", "left_semi")).withColumn("_new", F.lit(True)))
        else:
            new = new.withColumn("_new", F.lit(False))
        new = scratch.cut(new, "new")
        before = old.count()
        counts = new.agg(F.count_if("_new").alias("added"), F.count_if(~F.col("_new")).alias("kept")).first()
        self._put(table, new.drop("_new"), touched)
        return {"removed": before - counts["kept"], "added": counts["added"]}

    def _put(self, table: str, rows: DataFrame, touched: list[int]) -> None:
        filled = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        spread = rows.repartition(BUCKET, F.xxhash64(*[c for c in rows.columns if c != BUCKET]) % 8)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self._path(table))
        # A dynamic overwrite leaves buckets alone that got no row: those are emptied by name.
        for bucket in touched:
            if bucket not in filled:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/{BUCKET}={bucket}")
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
