"""An inverted index kept in step with the pages: stored posting segments, tombstones, and merging.

An update writes one segment with the postings of the pages it brings, and one tombstone for each page it touches; postings of older
segments of such a page are dead from then on.  Postings lie in buckets of their token, so a lookup reads the buckets of its words and
never a text.  Merging rewrites buckets without the dead postings.  Positions are stored as differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_table
from .search import token_index

POSTINGS = "token STRING, url STRING, gaps ARRAY<INT>, _segment BIGINT, _bucket INT"
TOMBSTONES = "url STRING, _segment BIGINT"
# Pages with dead postings travel to the postings up to this number; more are joined.
DEAD_BROADCAST = 1_000_000


class TextIndex:
    """Index files below ``root``.  One writer at a time; a segment number is used once."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, name: str, columns: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.root}/{name}")

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", TOMBSTONES)

    def _last(self) -> int:
        return self.tombstones().agg(F.max("_segment")).first()[0] or 0

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Put ``changed`` pages in place of what the index holds of them, and drop ``removed`` ones; returns the segment's number.

        Blocked pages and pages without a text are dropped as well.  Of several rows with one url all count, as one text each.
        """
        segment = self._last() + 1
        lists = token_index(changed)
        gaps = F.transform("positions", lambda x, i: x - F.coalesce(F.get("positions", i - 1), F.lit(0)))
        rows = lists.select("token", "url", gaps.alias("gaps"), F.lit(segment).cast("bigint").alias("_segment"), self._bucket(F.col("token")).alias("_bucket"))
        touched = changed.select("url")
        if removed is not None:
            touched = touched.unionByName(removed.select("url"))
        self._write(rows, touched, segment)
        return segment

    def _write(self, rows: DataFrame, touched: DataFrame | None, segment: int) -> None:
        """One segment; the pages it touches are those of its rows where ``touched`` is not given."""
        # What an attempt that was lost has left under this number goes first.
        self._drop(lambda n: n >= segment)
        # Every task writes the postings of its own pages into all buckets: the postings of a common word are as many as pages hold it.
        ordered = rows.sortWithinPartitions("_bucket", "_segment", "token")
        ordered.write.mode("append").partitionBy("_bucket", "_segment").parquet(f"{self.root}/postings")
        if touched is None:
            touched = self.postings().filter(F.col("_segment") == segment).select("url")
        # Written last: without its tombstones a segment never was.
        touched.distinct().withColumn("_segment", F.lit(segment).cast("bigint")).write.mode("append").partitionBy("_segment").parquet(f"{self.root}/tombstones")

    def _drop(self, which, names: tuple[str, ...] = ("postings",)) -> None:
        """Delete the folders of segments, bucket by bucket."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path
        files = target(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in names:
            for found in files.globStatus(target(f"{self.root}/{name}{'/_bucket=*' if name == 'postings' else ''}/_segment=*")) or []:
                if which(int(found.getPath().getName().split("=")[1])):
                    files.delete(found.getPath(), True)

    def _bucket(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings of the newest finished segment of their page."""
        stones = self.tombstones()
        newest = stones.groupBy("url").agg(F.max("_segment").alias("_newest"))
        # Only pages touched twice have dead postings; a segment without tombstones never was.
        dead = small_table(stones.join(newest, "url").filter(F.col("_segment") < F.col("_newest")).select("url", "_segment"), DEAD_BROADCAST)
        finished = [r[0] for r in stones.select("_segment").distinct().collect()]
        return postings.filter(F.col("_segment").isin(finished)).join(dead, ["url", "_segment"], "left_anti").select(*postings.columns)

    def lookup(self, phrase: str) -> DataFrame:
        """Urls of pages that hold the words of ``phrase`` in a row."""
        words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in phrase).split()]
        if not words:
            return self.spark.createDataFrame([], "url STRING")
        numbers = [self._bucket(F.lit(w)) for w in dict.fromkeys(words)]
        buckets = list(self.spark.range(1).select(*numbers).first())
        places = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(i).alias("offset")) for i, w in enumerate(words)])
        asked = self.spark.range(1).select(F.explode(places).alias("q")).select("q.token", "q.offset")
        found = self.postings().filter(F.col("_bucket").isin(buckets) & F.col("token").isin(list(dict.fromkeys(words))))
        rows = self.live(found).select("url", "token", F.posexplode("gaps").alias("_nth", "_gap"))
        upto = Window.partitionBy("url", "token").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = rows.withColumn("_at", F.sum("_gap").over(upto)).join(F.broadcast(asked), "token")
        starts = at.groupBy("url", (F.col("_at") - F.col("offset")).alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
        return starts.filter(F.col("_n") == len(words)).select("url").distinct()

    def merge(self) -> None:
        """Rewrite the index as one segment of its live postings; only then do the older segments and their tombstones go."""
        segment = self._last() + 1
        # The rows stay where they are read; their files are listed here, before the new segment is beside them.
        self._write(self.live(self.postings()).withColumn("_segment", F.lit(segment).cast("bigint")), None, segment)
        self._drop(lambda n: n < segment)
        self._drop(lambda n: n < segment, ("tombstones",))
