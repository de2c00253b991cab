"""Queries over the capture log: change flags, timeline events, recrawl intervals, current state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_micros
from ..operators import timeline as tl
from . import Query
from .inputs import ANNOTATED_SQL, EVENTS_SQL, STATE_SQL, annotated, captures, state


def _changes(spark, sf):
    return annotated(spark, sf).select(
        "capture_id", "page_url", "changed", "is_first", "recovered", "went_down", "is_dead",
        F.col("fails").cast("bigint").alias("fails"),
    )


def _intervals(spark, sf):
    return annotated(spark, sf).select("capture_id", F.col("streak").cast("bigint").alias("streak"), "interval_s")


def _timeline(spark, sf):
    return tl.page_events(annotated(spark, sf)).select(
        "event_id", "kind", "page_url", "hostname", "summary", "detail", iso_micros(F.col("occurred_at")).alias("occurred_at")
    )


def _kinds_per_host(spark, sf):
    return tl.page_events(annotated(spark, sf)).groupBy("hostname", "kind").agg(F.count(F.lit(1)).alias("n"))


def _state(spark, sf):
    s = state(spark, sf)
    return s.select(
        "url", "hostname", "status", "content_sha256", "blocked", "attempts",
        F.col("consecutive_failures").cast("bigint").alias("consecutive_failures"),
        iso_micros(F.col("content_captured_at")).alias("content_captured_at"),
        iso_micros(F.col("content_changed_at")).alias("content_changed_at"),
        iso_micros(F.col("next_crawl_at")).alias("next_crawl_at"),
    )


def _backfill(spark, sf):
    s = state(spark, sf)
    none_recorded = tl.page_events(annotated(spark, sf))  # live events carry no marker, so nothing is suppressed
    return tl.backfill(s, none_recorded).select(
        "page_url", "kind", "hostname", "summary", "detail", iso_micros(F.col("occurred_at")).alias("occurred_at")
    )


def _identifiers(spark, sf):
    """Identifiers of a version: the event's props value as a handle, its user group as a wallet, an e-mail that never links."""
    c = captures(spark, sf).select("capture_id").join(
        spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("capture_id"), "props", "user_id", "value"), "capture_id"
    )
    return c.select(
        "capture_id",
        F.explode(
            F.array(
                F.struct(F.lit("handle").alias("ioc_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("value")),
                F.struct(F.lit("btc").alias("ioc_type"), F.concat(F.lit("w"), F.floor(F.col("value") / 10).cast("string")).alias("value")),
                F.struct(F.lit("email").alias("ioc_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@corp.example")).alias("value")),
            )
        ).alias("i"),
    ).select("capture_id", "i.ioc_type", "i.value")


def _indicator_new(spark, sf):
    return tl.new_identifier_events(annotated(spark, sf), _identifiers(spark, sf)).select(
        "capture_id", "kind", "page_url", "summary", "detail"
    )


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"

QUERIES = {
    "change_flags": Query(
        _changes,
        f"WITH {ANNOTATED_SQL} SELECT capture_id, page_url, changed, is_first, recovered, went_down, is_dead, CAST(fails AS BIGINT) AS fails FROM annotated",
    ),
    "recrawl_intervals": Query(_intervals, f"WITH {ANNOTATED_SQL} SELECT capture_id, streak, interval_s FROM annotated"),
    "timeline_events": Query(
        _timeline,
        f"WITH {EVENTS_SQL} SELECT event_id, kind, page_url, hostname, summary, detail, {_TS.format('occurred_at')} AS occurred_at FROM timeline",
    ),
    "timeline_kinds_per_host": Query(
        _kinds_per_host, f"WITH {EVENTS_SQL} SELECT hostname, kind, count(*) AS n FROM timeline GROUP BY ALL"
    ),
    "page_state": Query(
        _state,
        f"""WITH {STATE_SQL} SELECT url, hostname, status, content_sha256, blocked, attempts, consecutive_failures,
        {_TS.format('content_captured_at')} AS content_captured_at, {_TS.format('content_changed_at')} AS content_changed_at,
        {_TS.format('next_crawl_at')} AS next_crawl_at FROM state""",
    ),
    "timeline_backfill": Query(
        _backfill,
        f"""WITH {STATE_SQL}
        SELECT url AS page_url, 'page_new' AS kind, hostname, 'First seen: ' || coalesce(title, url) AS summary,
          'reconstructed from stored page state' AS detail, {_TS.format('created_at')} AS occurred_at
        FROM state WHERE status IN ('crawled', 'dead') AND content_sha256 IS NOT NULL
        UNION ALL
        SELECT url, CASE WHEN content_sha256 IS NOT NULL THEN 'page_unreachable' ELSE 'page_dead' END, hostname,
          CASE WHEN content_sha256 IS NOT NULL THEN 'Stopped responding: ' || coalesce(title, url) ELSE 'Never answered: ' || url END,
          'reconstructed from stored page state', {_TS.format('fetched_at')}
        FROM state WHERE status = 'dead'""",
    ),
    "new_identifiers": Query(
        _indicator_new,
        f"""WITH {ANNOTATED_SQL},
        ident AS (
          SELECT event_id AS capture_id, 'handle' AS ioc_type, 'k' || json_extract_string(props, '$.k') AS value FROM events
          UNION ALL SELECT event_id, 'btc', 'w' || CAST(floor(value / 10) AS BIGINT) FROM events),
        vers AS (SELECT *, lag(capture_id) OVER (PARTITION BY page_url ORDER BY fetched_at, capture_id) AS before_id FROM annotated WHERE changed)
        SELECT v.capture_id, 'indicator_new' AS kind, v.page_url, 'New ' || i.ioc_type || ' on ' || v.title AS summary, i.value AS detail
        FROM vers v JOIN ident i USING (capture_id)
        WHERE NOT v.is_first AND NOT EXISTS (SELECT 1 FROM ident p WHERE p.capture_id = v.before_id AND p.ioc_type = i.ioc_type AND p.value = i.value)""",
    ),
}
