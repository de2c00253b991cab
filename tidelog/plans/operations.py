"""Queries over versions, retention, collection runs and the audit chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import humanize, iso_micros
from ..operators import history as hi
from ..operators import timeline as tl
from ..operators.indicators import extract_indicators
from ..operators.records import extract_credentials, extract_listings
from ..session import Scratch
from ..sources.page_tables import PageTables
from . import Query
from .alerts import VERSIONS_SQL, versions
from .extract import CREDENTIALS_SQL, INDICATORS_SQL, LISTINGS_SQL, PLANTED_SQL, planted
from .inputs import CAPTURES_SQL, EVENTS_SQL, STATE_SQL, annotated, state, table
from .lookup import stored_documents
from .state import EVENT_INDICATORS_SQL, event_indicators

PURGE_AS_OF = "2024-03-10 00:00:00"
AS_OF = "2002-01-01 00:00:00"
KEEP = 5


def runs(spark, sf):
    """Every order is a collection pass: its price is the duration, its customer decides what was fetched."""
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        n.alias("run_id"),
        start.alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("o_totalprice") * 100).cast("bigint") * 10_000)).alias("finished_at"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "running").otherwise("error").alias("status"),
        F.when(n % 2 == 0, start).alias("heartbeat_at"),
        F.when(c % 3 == 0, 0).otherwise(c).cast("bigint").alias("pages_crawled"),
        (c % 4).cast("bigint").alias("queued_at_start"),
        (n % 2).cast("bigint").alias("due_at_start"),
        F.lit(None).cast("string").alias("error"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_microseconds(CAST(round(o_totalprice * 100) AS BIGINT) * 10000) END AS finished_at,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'error' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS heartbeat_at,
  CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS pages_crawled, o_custkey % 4 AS queued_at_start, o_orderkey % 2 AS due_at_start FROM orders)"""


def _list_runs(spark, sf):
    r = hi.list_runs(runs(spark, sf), 100)
    return r.withColumn("started_at", iso_micros(F.col("started_at")))


def _closed(spark, sf):
    c = hi.close_abandoned(runs(spark, sf), "1995-06-01 00:00:00", 300)
    return c.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.count("finished_at").alias("finished"), F.count("error").alias("errors"))


def _health(spark, sf):
    return hi.collection_health(runs(spark, sf), AS_OF, 3600)


def _durations(spark, sf):
    """Humanised pass durations: the price in cents read as seconds."""
    o = table(spark, sf, "orders")
    seconds = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 0.01).otherwise(2)).cast("double")
    return o.select("o_orderkey", humanize(seconds).alias("age"))


def _audit(spark, sf):
    """Audit entries from events: each names its predecessor's digest as its own start; errors were edited afterwards."""
    e = table(spark, sf, "events")
    prev = F.sha2(F.concat(F.lit("chain"), (F.col("event_id") - 1).cast("string")), 256)
    actor, action, detail = F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("event_type"), F.col("props")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    digest = F.sha2(F.to_json(F.array(prev, actor, action, detail, at)), 256)
    edited = F.when(F.col("event_type") == "error", F.concat(detail, F.lit(" "))).otherwise(detail)
    return e.select(
        F.col("event_id").alias("id"), actor.alias("actor"), action.alias("action"), edited.alias("detail"), at.alias("at"), prev.alias("previous_hash"), digest.alias("entry_hash")
    )


def _audit_check(spark, sf):
    return hi.check_audit_chain(_audit(spark, sf), 1000)


def _audit_verdict(spark, sf):
    return hi.audit_verdict(_audit_check(spark, sf))


AUDIT_SQL = """au AS (SELECT event_id AS id, sha256('chain' || (event_id - 1)) AS prev, event_type = 'error' AS edited,
  sha256('["' || sha256('chain' || (event_id - 1)) || '","user' || user_id || '","' || event_type || '","' || replace(props, '"', '\\"') || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"]') AS entry_hash FROM events),
ac AS (SELECT id, entry_hash, prev = coalesce(lag(entry_hash) OVER (ORDER BY id), repeat('0', 64)) AS linked, NOT edited AS digest_ok FROM au)"""


# Lines counted per version; an added line counts as often as the later version has it more.
_DIFF_SQL = """p AS (SELECT page_url, version_id AS after_id, coalesce(content, '') AS content, lag(version_id) OVER w AS before_id, lag(coalesce(content, '')) OVER w AS old FROM {0} WINDOW w AS (PARTITION BY page_url ORDER BY version_id)),
  l AS (SELECT version_id, line, count(*) AS n FROM (SELECT version_id, unnest(regexp_split_to_array(coalesce(content, ''), '\\r\\n|\\n|\\r')) AS line FROM {0}) GROUP BY ALL),
  d AS (SELECT after_id, line, 1 AS side, n FROM p JOIN l ON l.version_id = after_id WHERE before_id IS NOT NULL UNION ALL SELECT after_id, line, -1, n FROM p JOIN l ON l.version_id = before_id),
  t AS (SELECT after_id, line, sum(side * n) AS k FROM d GROUP BY ALL),
  s AS (SELECT after_id, coalesce(sum(k) FILTER (k > 0), 0) AS added, coalesce(-sum(k) FILTER (k < 0), 0) AS removed FROM t GROUP BY after_id)
SELECT page_url, before_id, after_id, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, added = 0 AND removed = 0 AND content <> old AS moved FROM p JOIN s USING (after_id) WHERE before_id IS NOT NULL"""


def _retained(spark, sf):
    v = versions(spark, sf)
    cited = table(spark, sf, "events").filter("value > 180").select(F.col("event_id").alias("version_id"))
    blocked = state(spark, sf).filter("blocked").select(F.col("url").alias("page_url"))
    return hi.retained_versions(v, cited, blocked, KEEP).select("page_url", "version_id")


def _changes(spark, sf):
    d = hi.version_changes(versions(spark, sf))
    return d.select("page_url", "before_id", "after_id", F.size("added").cast("bigint").alias("added"), F.size("removed").cast("bigint").alias("removed"), "moved")


def _doc_versions(spark, sf):
    """Documents of one source and language as successive versions of one page."""
    return table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "lang").alias("page_url"), F.col("doc_id").alias("version_id"), F.lit(None).cast("timestamp").alias("captured_at"), F.col("text").alias("content")
    )


def _doc_changes(spark, sf):
    d = hi.version_changes(_doc_versions(spark, sf))
    return d.select("page_url", "before_id", "after_id", F.size("added").cast("bigint").alias("added"), F.size("removed").cast("bigint").alias("removed"), "moved")


def _purged(spark, sf):
    kept = hi.purge({"indicators": event_indicators(spark, sf)}, state(spark, sf), "2024-03-01 00:00:00", 60)
    pages = kept["pages"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("pages").alias("name"), "rows")
    return pages.unionByName(kept["indicators"].agg(F.count(F.lit(1)).alias("rows")).select(F.lit("indicators").alias("name"), "rows"))


def _purged_storage(spark, sf):
    """All six tables that hang on a page, written, purged of pages older than sixty days, and read back."""
    docs = stored_documents(spark, sf).withColumn("created_at", F.col("content_captured_at"))
    n, url = F.regexp_extract("title", "([0-9]+)", 1).cast("bigint"), F.col("url").alias("page_url")
    body = planted(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "label")
    held = {
        "indicators": extract_indicators(body).select("page_url", "ioc_type", "value"),
        "credentials": extract_credentials(body),
        "listings": extract_listings(body).select("page_url", "price", "currency"),
        "embeddings": docs.select(url, n.alias("n")).join(vectors, "n").select("page_url", "label"),
        "alerts": docs.select(url, n.alias("alert_id")),
        "versions": docs.select(url, F.explode(F.array(F.lit(1), F.lit(2))).alias("version_id"), "content_sha256"),
    }
    tables = PageTables(spark, f"{Scratch(spark).root}/kept", 16)
    for name, rows in held.items():
        tables.create(name, rows)
    left, manifest = hi.purge_stored(tables, list(held), docs, PURGE_AS_OF, 60)
    rows = left.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("url").alias("pages")).withColumn("name", F.lit("pages"))
    for name in held:
        rows = rows.unionByName(tables.read(name).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("page_url").alias("pages")).withColumn("name", F.lit(name)))
    return manifest.join(rows, "name")


def _events_per_run(spark, sf):
    """Timeline events per daily pass."""
    t = tl.page_events(annotated(spark, sf)).withColumn("run_id", F.date_format("occurred_at", "yyyy-MM-dd"))
    return hi.events_per_run(t)


def _listing(spark, sf):
    v = versions(spark, sf).withColumn("raw_body", F.when(F.col("body_truncated"), F.encode("content", "UTF-8"))).withColumn("legacy", F.lit(False))
    out = hi.version_listing(v, "http://h7.example/u7", 20)
    return out.select("version_id", "page_url", "body_sha256", "body_retained", "body_truncated", iso_micros(F.col("captured_at")).alias("captured_at"))



_PURGED = f"""WITH {INDICATORS_SQL}{CREDENTIALS_SQL[len(PLANTED_SQL) :]}{LISTINGS_SQL[len(PLANTED_SQL) :]},
held AS (SELECT 'indicators' AS name, page_url FROM indicators UNION ALL SELECT 'credentials', page_url FROM creds UNION ALL SELECT 'listings', page_url FROM listings
  UNION ALL SELECT 'embeddings', page_url FROM embeddings JOIN planted ON vec_id = doc_id UNION ALL SELECT 'alerts', page_url FROM planted
  UNION ALL SELECT 'versions', page_url FROM planted, range(2) UNION ALL SELECT 'pages', page_url FROM planted),
aged AS (SELECT name, page_url, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 60 DAY AS gone FROM held JOIN planted USING (page_url))
SELECT name, count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone) AS rows, count(DISTINCT page_url) FILTER (NOT gone) AS pages FROM aged GROUP BY name"""

QUERIES = {
    "retention_storage": Query(_purged_storage, _PURGED),
    "run_listing": Query(
        _list_runs,
        f"""WITH {RUNS_SQL} SELECT run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at, round_even((epoch_us(finished_at) - epoch_us(runs.started_at)) / 1000000.0::DOUBLE, 1) AS duration_s, status, pages_crawled,
          queued_at_start + due_at_start AS work_waiting, status = 'ok' AND pages_crawled = 0 AND queued_at_start + due_at_start > 0 AS stalled FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 100""",
    ),
    "closed_runs": Query(
        _closed,
        f"""WITH {RUNS_SQL}, c AS (SELECT *, status = 'running' AND coalesce(heartbeat_at, started_at) < TIMESTAMP '1995-06-01' - INTERVAL 300 SECOND AS dead FROM runs)
        SELECT CASE WHEN dead THEN 'abandoned' ELSE status END AS status, count(*) AS runs, count(CASE WHEN dead THEN 1 ELSE epoch_us(finished_at) END) AS finished, count(*) FILTER (dead) AS errors FROM c GROUP BY 1""",
    ),
    "collection_health": Query(
        _health,
        f"""WITH {RUNS_SQL}, rc AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE status NOT IN ('running', 'abandoned') QUALIFY n <= 10),
        st AS (SELECT coalesce(min(n) FILTER (NOT (status = 'ok' AND pages_crawled = 0 AND queued_at_start + due_at_start > 0)) - 1, count(*)) AS stalled FROM rc),
        la AS (SELECT *, queued_at_start + due_at_start AS waiting, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(finished_at)) / 1000000.0::DOUBLE AS since FROM rc WHERE n = 1),
        op AS (SELECT count(*) AS in_progress, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(coalesce(heartbeat_at, started_at)))) / 1000000.0 AS running_for FROM runs WHERE status = 'running')
        SELECT CASE WHEN la.status = 'error' THEN 'failing' WHEN in_progress = 0 AND since > 3600 THEN 'stale' WHEN in_progress > 0 AND running_for > 3600 THEN 'stale' WHEN stalled >= 2 THEN 'stalled' WHEN pages_crawled = 0 AND waiting = 0 THEN 'idle' ELSE 'ok' END AS status,
          in_progress, CAST(stalled AS BIGINT) AS consecutive_stalled, la.status AS last_status, round_even(since / 60, 1) AS minutes_ago,
          CASE WHEN since < 90 THEN CAST(trunc(since) AS BIGINT) || ' second(s)' WHEN since < 5400 THEN CAST(round_even(since / 60, 0) AS BIGINT) || ' minute(s)' WHEN since < 172800 THEN printf('%.1f', round_even(since / 3600, 1)) || ' hour(s)' ELSE printf('%.1f', round_even(since / 86400, 1)) || ' day(s)' END AS age,
          pages_crawled, waiting AS work_waiting FROM la, st, op""",
    ),
    "humanized_ages": Query(
        _durations,
        """WITH s AS (SELECT o_orderkey, floor(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 0.01::DOUBLE ELSE 2::DOUBLE END) AS s FROM orders)
        SELECT o_orderkey, CASE WHEN s < 90 THEN CAST(trunc(s) AS BIGINT) || ' second(s)' WHEN s < 5400 THEN CAST(round_even(s / 60, 0) AS BIGINT) || ' minute(s)' WHEN s < 172800 THEN printf('%.1f', round_even(s / 3600, 1)) || ' hour(s)' ELSE printf('%.1f', round_even(s / 86400, 1)) || ' day(s)' END AS age FROM s""",
    ),
    "recent_runs_kept": Query(
        lambda spark, sf: hi.purge_runs(runs(spark, sf), "1996-06-01 00:00:00", 30).groupBy("status").agg(F.count(F.lit(1)).alias("runs")),
        f"WITH {RUNS_SQL} SELECT status, count(*) AS runs FROM runs WHERE started_at >= TIMESTAMP '1996-06-01' - INTERVAL 30 DAY GROUP BY status",
    ),
    "events_per_run": Query(_events_per_run, f"WITH {EVENTS_SQL} SELECT strftime(occurred_at, '%Y-%m-%d') AS run_id, count(*) AS events FROM timeline GROUP BY 1"),
    "audit_entries_checked": Query(_audit_check, f"WITH {AUDIT_SQL} SELECT * FROM ac"),
    "audit_verdict": Query(
        _audit_verdict,
        f"""WITH {AUDIT_SQL} SELECT count(*) AS entries, count(*) FILTER (NOT linked) AS broken_links, count(*) FILTER (NOT digest_ok) AS bad_digests, min(id) FILTER (NOT (linked AND digest_ok)) AS failed_id,
          max_by(entry_hash, id) AS head_hash, min(id) FILTER (NOT (linked AND digest_ok)) IS NULL AS valid FROM ac""",
    ),
    "retained_versions": Query(
        _retained,
        f"""WITH {STATE_SQL}, {VERSIONS_SQL}, ok AS (SELECT * FROM versions WHERE page_url NOT IN (SELECT url FROM state WHERE blocked)),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY version_id DESC) AS r FROM ok)
        SELECT page_url, version_id FROM r WHERE r <= {KEEP} OR version_id IN (SELECT event_id FROM events WHERE value > 180)""",
    ),
    "version_changes": Query(_changes, f"WITH {CAPTURES_SQL}, {VERSIONS_SQL}, {_DIFF_SQL.format('versions')}"),
    "document_changes": Query(
        _doc_changes,
        f"""WITH v AS (SELECT source || '/' || lang AS page_url, doc_id AS version_id, text AS content FROM documents), {_DIFF_SQL.format('v')}""",
    ),
    "version_listing": Query(
        _listing,
        f"""WITH {CAPTURES_SQL}, {VERSIONS_SQL} SELECT version_id, page_url, body_sha256, coalesce(body_truncated, false) AS body_retained, body_truncated, strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f') AS captured_at
        FROM versions WHERE page_url = 'http://h7.example/u7' ORDER BY version_id DESC LIMIT 20""",
    ),
    "retention_cascade": Query(
        _purged,
        f"""WITH {STATE_SQL}, {EVENT_INDICATORS_SQL}, gone AS (SELECT url FROM state WHERE created_at < TIMESTAMP '2024-03-01' - INTERVAL 60 DAY)
        SELECT 'pages' AS name, count(*) AS rows FROM state WHERE url NOT IN (SELECT url FROM gone) UNION ALL SELECT 'indicators', count(*) FROM event_ind WHERE page_url NOT IN (SELECT url FROM gone)""",
    ),
}
