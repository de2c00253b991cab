import datetime as dt
import re

from pyspark.sql import functions as F

from tidelog.operators import history
from tidelog.operators.text_index import TextIndex
from tidelog.sources.page_tables import PageTables

PAGES = "url STRING, title STRING, content STRING, blocked BOOLEAN"


def holders(rows, phrase):
    norm = lambda text: " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    return sorted(u for u, title, content, blocked in rows if not blocked and norm(phrase) in norm(f"{title or ''} {content or ''}"))


def found(index, phrase):
    return sorted(r["url"] for r in index.lookup(phrase).collect())


PHRASES = ["the cat", "cat sat", "the the", "sat", "dog", "Dog, ran!", "missing word", "a b a"]


def test_updates_equal_a_rebuild(spark, tmp_path):
    first = [("u1", "T", "the cat sat on the the mat", False), ("u2", None, "a dog ran; the cat", False), ("u3", "T", "a b a b a", True), ("u4", "x", None, False), ("u5", "T", "a b a b a", False)]
    second = [("u1", "T", "no more of it", False), ("u2", None, "a dog ran; the cat", True), ("u6", "", "The Cat", False)]
    index = TextIndex(spark, str(tmp_path / "index"), 4)
    assert found(index, "cat") == []
    index.update(spark.createDataFrame(first, PAGES))
    assert [found(index, p) for p in PHRASES] == [holders(first, p) for p in PHRASES]
    index.update(spark.createDataFrame(second, PAGES), spark.createDataFrame([("u5",)], "url STRING"))
    now = [r for r in first if r[0] not in {"u1", "u2", "u5"}] + second
    assert [found(index, p) for p in PHRASES] == [holders(now, p) for p in PHRASES]
    index.merge()
    assert [found(index, p) for p in PHRASES] == [holders(now, p) for p in PHRASES]
    assert index.postings().select("_segment").distinct().count() == 1
    assert sorted(r["url"] for r in index.tombstones().collect()) == sorted(r["url"] for r in index.postings().select("url").distinct().collect())
    index.update(spark.createDataFrame(first, PAGES))
    again = [r for r in now if r[0] == "u6"] + first
    assert [found(index, p) for p in PHRASES] == [holders(again, p) for p in PHRASES]


def test_a_lost_update_leaves_nothing_and_a_lookup_reads_its_buckets(spark, tmp_path):
    rows = [(f"u{i}", "", f"word{i} common text", False) for i in range(20)]
    index = TextIndex(spark, str(tmp_path / "index"), 8)
    index.update(spark.createDataFrame(rows[:10], PAGES))
    # Postings of a segment whose tombstones were never written.
    stray = index.postings().withColumn("_segment", F.lit(2).cast("bigint"))
    stray.write.mode("append").partitionBy("_bucket", "_segment").parquet(str(tmp_path / "index/postings"))
    assert found(index, "common text") == sorted(u for u, *_ in rows[:10])
    index.update(spark.createDataFrame(rows[10:], PAGES))
    assert found(index, "common text") == sorted(u for u, *_ in rows)
    assert found(index, "word3 common") == ["u3"]
    plan = index.lookup("word3")._jdf.queryExecution().toString()
    assert any("PartitionFilters" in line and "_bucket" in line for line in plan.splitlines())


def test_purge_of_stored_tables(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    state = spark.createDataFrame([("u1", day(1)), ("u2", day(20)), ("u3", day(2)), ("u4", None)], "url STRING, created_at TIMESTAMP")
    tables = PageTables(spark, str(tmp_path / "t"), 4)
    for name, pages in (("indicators", ["u1", "u1", "u2"]), ("alerts", ["u3"]), ("versions", ["u2", "u4"])):
        tables.create(name, spark.createDataFrame([(u, i) for i, u in enumerate(pages)], "page_url STRING, n INT"))
    left, manifest = history.purge_stored(tables, ["indicators", "alerts", "versions", "absent"], state, "2024-01-30 00:00:00", 20)
    assert {r["name"]: r["removed"] for r in manifest.collect()} == {"indicators": 2, "alerts": 1, "versions": 0, "absent": 0, "pages": 2}
    assert sorted(r["url"] for r in left.collect()) == ["u2", "u4"]
    assert [r["page_url"] for r in tables.read("indicators").collect()] == ["u2"] and tables.read("alerts").count() == 0 and tables.read("versions").count() == 2
    kept, manifest = history.purge_stored(tables, ["indicators"], state, "2024-01-30 00:00:00", 0)
    assert kept.count() == 4 and manifest.agg(F.sum("removed")).first()[0] == 0
