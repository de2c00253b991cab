"""Deterministic views of the driver tables in the shapes the operators expect, with their SQL twins.

Each ``*_SQL`` constant is a list of CTE definitions (``name AS (...)``) that builds the same rows as the function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..session import spread

BASE_S, MAX_S, MAX_FAILURES = 3600, 28_800, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need heavy per-row work, spread over all cores when it is stored in few splits."""
    return spread(table(spark, sf_dir, name))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch observation per event: url from the user, body from the event type, failure for ``error``."""
    return captures_of(spread(table(spark, sf_dir, "events"), by_file=True))


def captures_of(e: DataFrame, *more) -> DataFrame:
    """``captures`` of a batch or a stream of events, with ``more`` columns of them."""
    ok = F.col("event_type") != "error"
    host = F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"), F.lit(".example"))
    return e.select(
        F.col("event_id").alias("capture_id"),
        F.concat(F.lit("http://"), host, F.lit("/u"), F.col("user_id").cast("string")).alias("page_url"),
        host.alias("hostname"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        ok.alias("ok"),
        F.when(ok, F.sha2(F.col("event_type"), 256)).alias("content_sha256"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("blocked"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        F.when(ok, F.repeat(F.concat("event_type", F.lit(" ")), F.when(F.col("event_type") == "click", 10).otherwise(20))).alias("content"),
        F.when(F.col("event_type") == "click", F.lit(True)).when(F.col("event_type") != "signup", F.lit(False)).alias("body_truncated"),
        F.when(~ok, F.lit("timeout")).alias("error"),
        *more,
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.annotate(captures(spark, sf_dir), BASE_S, MAX_S, MAX_FAILURES)


CAPTURES_SQL = """captures AS (
  SELECT event_id AS capture_id,
    'http://h' || (user_id % 20) || '.example/u' || user_id AS page_url,
    'h' || (user_id % 20) || '.example' AS hostname,
    ts AS fetched_at, event_type <> 'error' AS ok,
    CASE WHEN event_type <> 'error' THEN sha256(event_type) END AS content_sha256,
    (event_type = 'purchase' AND value > 150) AS blocked,
    'User ' || user_id AS title,
    CASE WHEN event_type <> 'error' THEN repeat(event_type || ' ', CASE WHEN event_type = 'click' THEN 10 ELSE 20 END) END AS content,
    CASE WHEN event_type = 'click' THEN true WHEN event_type <> 'signup' THEN false END AS body_truncated,
    CASE WHEN event_type = 'error' THEN 'timeout' END AS error
  FROM events)"""

ANNOTATED_SQL = CAPTURES_SQL + f""",
ann_a AS (
  SELECT *, CASE WHEN ok THEN content_sha256 || '/' || blocked END AS k,
    sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS fail_sum,
    lag(ok) OVER w AS prev_obs
  FROM captures WINDOW w AS (PARTITION BY page_url ORDER BY fetched_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ann_b AS (
  SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY page_url ORDER BY fetched_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_k,
    fail_sum - coalesce(max(CASE WHEN ok THEN fail_sum END) OVER (PARTITION BY page_url ORDER BY fetched_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS fails
  FROM ann_a),
ann_c AS (
  SELECT *, ok AND prev_k IS NULL AS is_first,
    ok AND (prev_k IS NULL OR prev_k <> k) AS changed,
    ok AND prev_k IS NOT NULL AND NOT prev_obs AS recovered,
    coalesce(NOT ok AND prev_k IS NOT NULL AND prev_obs, false) AS went_down,
    NOT ok AND fails >= {MAX_FAILURES} AS is_dead,
    ok OR prev_k IS NOT NULL AS ever_ok,
    sum(CASE WHEN ok AND prev_k = k THEN 1 ELSE 0 END) OVER (PARTITION BY page_url ORDER BY fetched_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same_sum
  FROM ann_b),
ann AS (
  SELECT *, CAST(same_sum - coalesce(max(CASE WHEN changed THEN same_sum END) OVER (PARTITION BY page_url ORDER BY fetched_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS streak
  FROM ann_c),
annotated AS (
  SELECT *, CASE WHEN ok THEN CASE WHEN NOT blocked THEN CASE WHEN streak = 0 THEN CAST({BASE_S} AS DOUBLE) ELSE least({BASE_S} * pow(2.0, streak), {MAX_S}) END END
      WHEN NOT is_dead THEN CAST(least({BASE_S} * fails, {MAX_S}) AS DOUBLE) END AS interval_s
  FROM ann)"""

EVENTS_SQL = ANNOTATED_SQL + """,
timeline AS (
  SELECT capture_id * 10000 + 1 AS event_id, capture_id, fetched_at AS occurred_at, 'page_unreachable' AS kind, hostname, page_url, 'Stopped responding: ' || title AS summary, error AS detail FROM annotated WHERE went_down
  UNION ALL SELECT capture_id * 10000 + 2, capture_id, fetched_at, 'page_dead', hostname, page_url, 'Given up after ' || CAST(fails AS BIGINT) || ' failed fetch(es): ' || page_url, error FROM annotated WHERE is_dead
  UNION ALL SELECT capture_id * 10000 + 3, capture_id, fetched_at, 'page_recovered', hostname, page_url, 'Back online: ' || title, NULL FROM annotated WHERE recovered
  UNION ALL SELECT capture_id * 10000 + 4, capture_id, fetched_at, 'page_new', hostname, page_url, 'New page: ' || title, NULL FROM annotated WHERE is_first
  UNION ALL SELECT capture_id * 10000 + 5, capture_id, fetched_at, 'page_changed', hostname, page_url, 'Content changed: ' || title, NULL FROM annotated WHERE changed AND NOT is_first)"""

STATE_CTE = """,
page_last AS (SELECT * FROM annotated QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY fetched_at DESC, capture_id DESC) = 1),
page_good AS (SELECT * FROM annotated WHERE ok QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY fetched_at DESC, capture_id DESC) = 1),
page_agg AS (SELECT page_url, min(fetched_at) AS created_at, max(CASE WHEN ok THEN fetched_at END) AS content_captured_at, max(CASE WHEN changed THEN fetched_at END) AS content_changed_at, count(*) AS attempts FROM annotated GROUP BY page_url),
state AS (
  SELECT l.page_url AS url, l.hostname,
    CASE WHEN l.ok AND l.blocked THEN 'blocked' WHEN l.ok THEN 'crawled' WHEN l.is_dead OR NOT l.ever_ok THEN 'dead' ELSE 'crawled' END AS status,
    CASE WHEN NOT coalesce(g.blocked, false) THEN g.content END AS content, g.title, g.body_truncated, g.content_sha256,
    coalesce(g.blocked, false) AS blocked, CAST(l.fails AS BIGINT) AS consecutive_failures, a.attempts, a.created_at, l.fetched_at,
    a.content_captured_at, a.content_changed_at, l.fetched_at + to_microseconds(CAST(l.interval_s * 1000000 AS BIGINT)) AS next_crawl_at
  FROM page_last l JOIN page_agg a USING (page_url) LEFT JOIN page_good g USING (page_url))"""

STATE_SQL = EVENTS_SQL + STATE_CTE


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.page_state(annotated(spark, sf_dir))
