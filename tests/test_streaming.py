import random

import pytest
from pyspark.sql import functions as F

from test_timeline import log
from tidelog.operators import timeline as tl
from tidelog.streaming import live, tracked
from tidelog.streaming.alert_store import ALERT, AlertStore, content_sink, event_sink

FLAGS = ["capture_id", "changed", "is_first", "recovered", "went_down", "is_dead", "ever_ok", "fails", "streak", "interval_s"]


def run_stream(df, name, spark, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def files_in_time_order(df, path, n):
    """Write the log as ``n`` files whose modification order follows capture time."""
    rows = df.orderBy("fetched_at", "capture_id").collect()
    step = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)


def test_live_timeline_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    captures = log(spark, {f"p{i}": "".join(rng.choice("aaabBxx!!") for _ in range(18)) for i in range(12)})
    files_in_time_order(captures, str(tmp_path / "log"), 3)
    assert captures.filter("forced").count() > 3
    schema = captures.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = run_stream(live.live_annotations(live.unique_captures(stream), 100, 1000, 3), "live_notes", spark)
    batch = tl.annotate(captures, 100, 1000, 3)
    assert out.filter("late").count() == 0
    assert sorted(map(tuple, out.select(*FLAGS).collect()), key=str) == sorted(map(tuple, batch.select(*FLAGS).collect()), key=str)
    events = sorted(map(tuple, tl.page_events(out).select("event_id", "kind", "summary").collect()))
    assert events == sorted(map(tuple, tl.page_events(batch).select("event_id", "kind", "summary").collect()))


def test_late_and_repeated_captures(spark, tmp_path):
    captures = log(spark, {"p": "abc"}).drop("forced")
    path = str(tmp_path / "log")
    for ids in ([0, 2], [1], [2]):
        captures.filter(F.col("capture_id").isin(ids)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = {r["capture_id"]: r["late"] for r in run_stream(live.live_annotations(live.unique_captures(stream, "30 days")), "live_late", spark).collect()}
    assert rows == {0: False, 2: False, 1: True}


def test_live_extraction_drops_refused_text(spark, tmp_path):
    pages = spark.createDataFrame(
        [("http://a.onion/1", "<body>Vendor: Neo77 a@b.com:hunter2</body>", "text/html", "aa"), ("http://a.onion/2", "<body>forbidden Vendor: Bad</body>", "text/html", "bb")],
        "url STRING, html STRING, content_type STRING, content_sha256 STRING",
    )
    pages.write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
    rules = spark.createDataFrame([(1, "x", "forbidden")], "position INT, category STRING, pattern STRING")
    out = live.live_extraction(stream, rules, spark.createDataFrame([], "sha256 STRING"))
    found = run_stream(out["indicators"], "live_ind", spark).collect()
    assert {(r["page_url"], r["ioc_type"], r["value"]) for r in found} == {("http://a.onion/1", "handle", "Neo77"), ("http://a.onion/1", "email", "a@b.com")}
    assert run_stream(out["credentials"], "live_cred", spark).count() == 1


@pytest.mark.parametrize("replay", [False, True])
def test_live_alerts_are_written_once(spark, tmp_path, replay):
    captures = log(spark, {"p": "axa", "q": "ax"}).drop("forced")
    events = tl.page_events(tl.annotate(captures))
    lists = spark.createDataFrame([(1, "n", "event", "notable", None, True)], "watchlist_id BIGINT, name STRING, kind STRING, value STRING, webhook_url STRING, active BOOLEAN")
    versions = spark.createDataFrame([], "page_url STRING, version_id BIGINT, captured_at TIMESTAMP, content STRING")
    path = str(tmp_path / "alerts")
    sink = live.alert_sink(path, lists, ("event_id", "occurred_at", "kind", "hostname", "page_url", "summary", "detail"), lambda: versions)
    sink(events, 0)
    if replay:
        sink(events, 0)
    assert sorted(r["dedup_key"].startswith("event:") for r in spark.read.parquet(path).collect()) == [True, True, True]


def test_live_content_alerts_remember_bodies(spark, tmp_path):
    schema = "url STRING, hostname STRING, title STRING, content STRING, content_sha256 STRING, blocked BOOLEAN, body_truncated BOOLEAN"
    first = spark.createDataFrame([("u1", "h", "t", "acme", "B", False, False)], schema)
    second = spark.createDataFrame([("u2", "h", "t", "acme", "B", False, False), ("u3", "h", "t", "acme", "C", False, False), ("u4", "h", "t", "acme", "D", True, False)], schema)
    lists = spark.createDataFrame([(1, "k", "keyword", "ACME", None, True)], "watchlist_id BIGINT, name STRING, kind STRING, value STRING, webhook_url STRING, active BOOLEAN")
    path = str(tmp_path / "alerts")
    sink = live.content_alert_sink(path, lists)
    sink(first, 0)
    sink(second, 1)
    assert sorted(r["page_url"] for r in spark.read.parquet(path).collect()) == ["u1", "u3"]


IDENTIFIED = "ARRAY<STRUCT<ioc_type: STRING, value: STRING>>"


def tracked_log(spark, captures, batches, path):
    """Captures delivered in the given batches of ids; the stream is stopped after each."""
    tracked.use_state_store(spark)
    held = F.array(F.struct(F.lit("handle").alias("ioc_type"), F.concat(F.lit("n"), "content_sha256").alias("value")), F.struct(F.lit("btc").alias("ioc_type"), (F.col("capture_id") % 2).cast("string").alias("value")))
    captures = captures.withColumn("identifiers", F.when(F.col("ok"), held).cast(IDENTIFIED))
    for ids in batches:
        rows = captures.join(spark.createDataFrame([(i,) for i in ids], "capture_id BIGINT"), "capture_id").select(*captures.columns)
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(captures.schema).parquet(f"{path}/in")
        notes = tracked.tracked_captures(stream, 100, 1000, 3)
        notes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(notes.schema).parquet(f"{path}/out")


def noted(df):
    return sorted(map(tuple, df.select(*FLAGS, "prev_title").collect()), key=str)


def test_tracked_captures_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    captures = log(spark, {f"p{i}": "".join(rng.choice("aaabBxx!!") for _ in range(15)) for i in range(8)})
    rows = captures.orderBy("fetched_at", "capture_id").collect()
    ids = [r["capture_id"] for r in rows]
    out = tracked_log(spark, captures, [ids[:50], ids[50:80] + ids[40:45] * 2, ids[80:]], str(tmp_path))
    batch = tl.annotate(captures, 100, 1000, 3)
    assert out.filter("late").count() == 10
    assert noted(out.filter("NOT late")) == noted(batch)
    found = captures.filter("ok").select("capture_id", F.explode(F.array(F.struct(F.lit("handle").alias("t"), F.concat(F.lit("n"), "content_sha256").alias("v")), F.struct(F.lit("btc").alias("t"), (F.col("capture_id") % 2).cast("string").alias("v")))).alias("i"))
    found = found.select("capture_id", F.col("i.t").alias("ioc_type"), F.col("i.v").alias("value"))
    events = tracked.tracked_events(out)
    want = tl.page_events(batch).select("capture_id", "kind", "summary", "detail").unionByName(tl.new_identifier_events(batch, found).select("capture_id", "kind", "summary", "detail"))
    assert sorted(map(str, events.select("capture_id", "kind", "summary", "detail").collect())) == sorted(map(str, want.collect()))
    assert events.filter("kind = 'indicator_new'").count() > 5 and events.count() == events.select("event_id").distinct().count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_of_late_captures_equals_the_whole_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    captures = log(spark, {f"p{i}": "".join(rng.choice("aaabBxx!") for _ in range(20)) for i in range(6)})
    ids = [r["capture_id"] for r in captures.orderBy("fetched_at", "capture_id").collect()]
    slow = {i for i in ids if rng.random() < 0.2}
    out = tracked_log(spark, captures, [[i for i in ids if i not in slow], sorted(slow) + ids[:10]], str(tmp_path))
    fixed = tracked.repair_late(out, 100, 1000, 3)
    assert noted(fixed) == noted(tl.annotate(captures, 100, 1000, 3))


def test_repair_scans_only_chunks_that_begin_in_another_state(spark):
    captures = log(spark, {"p": "aaaabbbbcccc", "q": "aaaa"}, 24)
    late = captures.filter("page_url = 'p' AND capture_id = 2")
    kept = captures.filter("NOT (page_url = 'p' AND capture_id = 2)")
    notes = tl.annotate(kept, 100, 1000, 3)
    changed, chunks, _ = tl.repair(notes, tl.chunk_summaries(kept), late, 100, 1000, 3)
    # The day of the late row and the days until the body changes and the streak begins anew.
    assert chunks.count() == 10 and changed.select("page_url").distinct().count() == 1
    assert noted(tl.repaired(notes, changed, chunks)) == noted(tl.annotate(captures, 100, 1000, 3))
    again, none, _ = tl.repair(notes, tl.chunk_summaries(kept), kept, 100, 1000, 3)
    assert again.count() == none.count() == 0


def test_alert_store_reads_only_touched_partitions_and_survives_replays(spark, tmp_path):
    captures = log(spark, {f"p{i}": "axaxa" for i in range(6)}, 24).drop("forced")
    events = tl.page_events(tl.annotate(captures)).withColumn("hostname", F.lit("h"))
    lists = spark.createDataFrame([(1, "n", "event", "notable", None, True)], "watchlist_id BIGINT, name STRING, kind STRING, value STRING, webhook_url STRING, active BOOLEAN")
    versions = spark.createDataFrame([], "page_url STRING, version_id BIGINT, captured_at TIMESTAMP, content STRING")
    store = AlertStore(spark, str(tmp_path / "alerts"), 4)
    sink = event_sink(store, lists, lambda: versions)
    days = sorted({r[0] for r in events.select(F.to_date("occurred_at")).collect()})
    first, second = events.filter(F.to_date("occurred_at") <= days[2]), events.filter(F.to_date("occurred_at") >= days[2])
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 2)):
        sink(batch, number)
    want = events.filter(F.col("kind").isin("page_unreachable", "page_recovered", "page_dead")).count()
    assert store.event_alerts().count() == want == store.event_alerts().select("dedup_key").distinct().count()
    places = spark.createDataFrame([(days[1], 2)], "_day DATE, _bucket INT")
    plan = store.prior("events", ALERT, places, 9)._jdf.queryExecution().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "_day" in filters and "_bucket" in filters and "_batch" in filters


def test_stored_content_alerts_remember_bodies_and_pages(spark, tmp_path):
    schema = "url STRING, hostname STRING, title STRING, content STRING, content_sha256 STRING, blocked BOOLEAN, body_truncated BOOLEAN"
    first = spark.createDataFrame([("u1", "h", "t", "acme", "B", False, False)], schema)
    second = spark.createDataFrame([("u2", "h", "t", "acme", "B", False, False), ("u3", "h", "t", "acme", "C", False, False), ("u4", "h", "t", "acme", "D", True, False), ("u1", "h", "t", "acme 2", "E", False, False), ("u5", "h", "t", "acme", None, False, True)], schema)
    lists = spark.createDataFrame([(1, "k", "keyword", "ACME", None, True)], "watchlist_id BIGINT, name STRING, kind STRING, value STRING, webhook_url STRING, active BOOLEAN")
    store = AlertStore(spark, str(tmp_path / "alerts"), 4)
    sink = content_sink(store, lists)
    for batch, number in ((first, 0), (second, 1), (second, 1), (second, 2)):
        sink(batch, number)
    assert sorted(r["page_url"] for r in store.content_alerts().collect()) == ["u1", "u3", "u5"]
