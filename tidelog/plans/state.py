"""Queries over page state: liveness, sites, counts, quality, duplicates, listings of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_micros
from ..operators import timeline as tl
from ..operators import views
from ..session import Scratch
from . import Query
from .inputs import EVENTS_SQL, STATE_SQL, annotated, captures, state, table

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
AS_OF = "2024-01-31 00:00:00"
CURRENT_MODEL = "hashing-64"


def _stamp(df, *names):
    return df.withColumns({n: iso_micros(F.col(n)) for n in names})


def event_indicators(spark, sf):
    """Indicator sightings of a page: the props key as a handle and the e-mail of the user, one row per event."""
    e = table(spark, sf, "events")
    host = F.concat(F.lit("http://h"), (F.col("user_id") % 20).cast("string"), F.lit(".example/u"), F.col("user_id").cast("string"))
    return e.select(
        host.alias("page_url"),
        F.explode(
            F.array(
                F.struct(F.lit("handle").alias("ioc_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("value")),
                F.struct(F.lit("email").alias("ioc_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@corp.example")).alias("value")),
            )
        ).alias("i"),
    ).select("page_url", "i.ioc_type", "i.value")


EVENT_INDICATORS_SQL = """event_ind AS (
  SELECT 'http://h' || (user_id % 20) || '.example/u' || user_id AS page_url, 'handle' AS ioc_type, 'k' || json_extract_string(props, '$.k') AS value FROM events
  UNION ALL SELECT 'http://h' || (user_id % 20) || '.example/u' || user_id, 'email', 'u' || user_id || '@corp.example' FROM events)"""


def capture_pages(spark, sf):
    """Every capture as a page of its own, which gives quality and duplicate views many bodies to work on."""
    return captures(spark, sf).select(
        F.concat("page_url", F.lit("/c"), F.col("capture_id").cast("string")).alias("url"),
        "hostname",
        "title",
        F.when(~F.col("blocked"), F.col("content")).alias("content"),
        "content_sha256",
        "body_truncated",
        "blocked",
        F.when(F.col("ok"), F.col("fetched_at")).alias("content_captured_at"),
        F.when(F.col("content").contains("purchase"), "[]").when(F.col("content").contains("view"), '[{"extractor":"ioc"}]').alias("extraction_errors"),
    )


CAPTURE_PAGES_SQL = """capture_pages AS (
  SELECT page_url || '/c' || capture_id AS url, hostname, title, CASE WHEN NOT blocked THEN content END AS content, content_sha256, body_truncated, blocked,
    CASE WHEN ok THEN fetched_at END AS content_captured_at,
    CASE WHEN contains(content, 'purchase') THEN '[]' WHEN contains(content, 'view') THEN '[{"extractor":"ioc"}]' END AS extraction_errors FROM captures)"""


def _annotated_once(spark, sf):
    """The annotated log as a stored table, for plans that read it twice."""
    return Scratch(spark).cut(annotated(spark, sf).drop("content"), "annotated")


def _liveness(spark, sf):
    a = _annotated_once(spark, sf)
    return _stamp(views.host_liveness(tl.page_state(a), tl.page_events(a)), "last_fetch", "last_change", "offline_since")


def _liveness_ranked(spark, sf):
    a = _annotated_once(spark, sf)
    return views.rank_liveness(views.host_liveness(tl.page_state(a), tl.page_events(a)), 10).select("host", "state", "known")


_LIVENESS_SQL = (
    STATE_SQL
    + """,
live0 AS (SELECT hostname, count(*) AS known,
    count(*) FILTER (status = 'crawled' AND consecutive_failures = 0) AS live,
    count(*) FILTER (status = 'crawled' AND consecutive_failures > 0) AS failing,
    count(*) FILTER (status = 'dead') AS dead, count(content_sha256) AS answered, max(fetched_at) AS last_fetch, max(content_changed_at) AS last_change
  FROM state GROUP BY hostname),
outage AS (SELECT hostname, max(occurred_at) AS went_at FROM timeline WHERE kind IN ('page_unreachable', 'page_dead') GROUP BY hostname),
live1 AS (SELECT l.*, o.went_at, CASE WHEN live > 0 THEN 'up' WHEN failing > 0 OR (dead > 0 AND answered > 0) THEN 'down' WHEN dead > 0 THEN 'never' ELSE 'unknown' END AS state
  FROM live0 l LEFT JOIN outage o USING (hostname))"""
)


def _down_pages(spark, sf):
    """Liveness with one host per page, so that every state occurs."""
    a = _annotated_once(spark, sf)
    s = tl.page_state(a).withColumn("hostname", F.col("url"))
    t = tl.page_events(a).withColumn("hostname", F.col("page_url"))
    return _stamp(views.host_liveness(s, t).select("host", "state", "failing", "dead", "offline_since"), "offline_since")


def _sites(spark, sf):
    s = state(spark, sf).withColumn("pinned", F.col("url").endswith("u1") | F.col("url").endswith("u7"))
    return views.sites(s, event_indicators(spark, sf))


def _overview(spark, sf):
    return views.overview_counts(state(spark, sf), event_indicators(spark, sf))


def _quality(spark, sf):
    return views.collection_quality(capture_pages(spark, sf), AS_OF)


def _duplicates(spark, sf):
    return views.duplicate_groups(capture_pages(spark, sf)).select("content_sha256", "copies", F.size("sources").cast("bigint").alias("listed"), F.col("sources")[0]["url"].alias("first_url"), F.element_at("sources", -1)["url"].alias("last_url"))


def document_pages(spark, sf):
    """Documents as captured pages: source is the host, the text is the body."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("source", F.lit(".onion")).alias("hostname"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_sha256"),
        F.lit(False).alias("blocked"),
        F.lit(False).alias("body_truncated"),
        "doc_id",
        "lang",
    )


DOCUMENT_PAGES_SQL = """document_pages AS (
  SELECT 'http://' || source || '.onion/d' || doc_id AS url, source || '.onion' AS hostname, text AS content, sha256(text) AS content_sha256, false AS blocked, false AS body_truncated, doc_id, lang FROM documents)"""


def _document_duplicates(spark, sf):
    groups = views.duplicate_groups(document_pages(spark, sf))
    return groups.select("content_sha256", "copies", F.array_join(F.transform("sources", lambda s: s["url"]), " ").alias("urls"))


def _coverage(spark, sf):
    v = table(spark, sf, "embeddings").select(
        F.concat(F.lit("http://src"), (F.col("vec_id") % 20).cast("string"), F.lit(".onion/d"), F.col("vec_id").cast("string")).alias("page_url"),
        F.when(F.col("label") < 5, CURRENT_MODEL).otherwise("older-64").alias("model"),
        F.size("embedding").alias("dim"),
    )
    return views.embedding_coverage(document_pages(spark, sf), v, CURRENT_MODEL, 64).withColumn("dim", F.col("dim").cast("bigint"))


def _recent_timeline(spark, sf):
    return _stamp(
        views.filter_timeline(tl.page_events(annotated(spark, sf)), notable_only=True, host="h3.example", limit=100).select("event_id", "kind", "page_url", "occurred_at"),
        "occurred_at",
    )


def _pages(spark, sf):
    return views.filter_pages(state(spark, sf), status="crawled", host="h5.example", limit=5, offset=2).select("url", "status", "attempts")


def _waiting(spark, sf):
    return views.work_waiting(state(spark, sf), AS_OF)


def _waiting_scoped(spark, sf):
    s = state(spark, sf).withColumn("depth", F.length("url") % 3)
    return views.work_waiting(s, "2024-01-30 18:00:00", max_depth=1, hosts=["h1.example", "h2.example", "h11.example", "h13.example"])


def _table_counts(spark, sf):
    return views.table_counts(pages=state(spark, sf), indicators=event_indicators(spark, sf), vectors=table(spark, sf, "embeddings"))


QUERIES = {
    "copied_bodies": Query(
        lambda spark, sf: views.copied_bodies(document_pages(spark, sf)),
        f"""WITH {DOCUMENT_PAGES_SQL} SELECT content_sha256, count(*) OVER (PARTITION BY content_sha256) AS copies, url, hostname FROM document_pages WHERE content_sha256 IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY content_sha256) > 1""",
    ),
    "host_liveness": Query(
        _liveness,
        f"WITH {_LIVENESS_SQL} SELECT hostname AS host, state, known, live, failing, dead, {_TS.format('last_fetch')} AS last_fetch, {_TS.format('last_change')} AS last_change, {_TS.format('CASE WHEN state = ' + chr(39) + 'down' + chr(39) + ' THEN went_at END')} AS offline_since FROM live1",
    ),
    "host_liveness_ranked": Query(
        _liveness_ranked,
        f"WITH {_LIVENESS_SQL} SELECT hostname AS host, state, known FROM live1 ORDER BY CASE state WHEN 'down' THEN 0 WHEN 'up' THEN 1 WHEN 'never' THEN 2 ELSE 3 END, known DESC, host LIMIT 10",
    ),
    "page_liveness": Query(
        _down_pages,
        f"""WITH {STATE_SQL},
        o AS (SELECT page_url, max(occurred_at) AS went_at FROM timeline WHERE kind IN ('page_unreachable', 'page_dead') GROUP BY 1),
        l AS (SELECT url AS host, CASE WHEN status = 'crawled' AND consecutive_failures = 0 THEN 'up' WHEN status = 'crawled' OR (status = 'dead' AND content_sha256 IS NOT NULL) THEN 'down' WHEN status = 'dead' THEN 'never' ELSE 'unknown' END AS state,
          CAST(status = 'crawled' AND consecutive_failures > 0 AS BIGINT) AS failing, CAST(status = 'dead' AS BIGINT) AS dead FROM state)
        SELECT host, state, failing, dead, {_TS.format("CASE WHEN state = 'down' THEN went_at END")} AS offline_since FROM l LEFT JOIN o ON host = page_url""",
    ),
    "site_table": Query(
        _sites,
        f"""WITH {STATE_SQL}, {EVENT_INDICATORS_SQL},
        i AS (SELECT page_url, count(*) AS n FROM event_ind GROUP BY 1)
        SELECT hostname AS host, count(*) FILTER (status = 'crawled') AS crawled, count(*) FILTER (status = 'discovered') AS queued,
          count(*) FILTER (status = 'dead' OR (status = 'crawled' AND consecutive_failures > 0)) AS unreachable, CAST(coalesce(sum(n), 0) AS BIGINT) AS iocs,
          bool_or(url LIKE '%u1' OR url LIKE '%u7') AS pinned
        FROM state LEFT JOIN i ON url = page_url GROUP BY hostname""",
    ),
    "pages_by_status": Query(
        lambda spark, sf: views.pages_by_status(state(spark, sf)), f"WITH {STATE_SQL} SELECT status, count(*) AS pages FROM state GROUP BY status"
    ),
    "table_counts": Query(
        _table_counts,
        f"""WITH {STATE_SQL}, {EVENT_INDICATORS_SQL} SELECT 'pages' AS name, count(*) AS rows FROM state
        UNION ALL SELECT 'indicators', count(*) FROM event_ind UNION ALL SELECT 'vectors', count(*) FROM embeddings""",
    ),
    "overview_counts": Query(
        _overview,
        f"""WITH {STATE_SQL}, {EVENT_INDICATORS_SQL}
        SELECT (SELECT count(*) FROM state WHERE NOT blocked AND content IS NOT NULL) AS pages, (SELECT count(*) FROM state WHERE status = 'discovered') AS queued,
          (SELECT count(*) FROM state WHERE status = 'dead' OR (status = 'crawled' AND consecutive_failures > 0)) AS unreachable,
          (SELECT count(*) FROM event_ind) AS iocs, (SELECT count(*) FROM (SELECT DISTINCT ioc_type, value FROM event_ind)) AS unique_iocs""",
    ),
    "top_hosts": Query(
        lambda spark, sf: views.top_groups(document_pages(spark, sf), "hostname", 8),
        f"WITH {DOCUMENT_PAGES_SQL} SELECT hostname AS name, count(*) AS n FROM document_pages GROUP BY 1 ORDER BY n DESC, name LIMIT 8",
    ),
    "recent_pages": Query(
        lambda spark, sf: _stamp(views.recent_pages(state(spark, sf)).select("url", "hostname", "fetched_at"), "fetched_at"),
        f"WITH {STATE_SQL} SELECT url, hostname, {_TS.format('fetched_at')} AS fetched_at FROM (SELECT * FROM state WHERE status = 'crawled' ORDER BY state.fetched_at DESC, url LIMIT 8)",
    ),
    "distinct_indicators": Query(
        lambda spark, sf: views.distinct_indicators(event_indicators(spark, sf), "handle, email"),
        f"WITH {EVENT_INDICATORS_SQL} SELECT ioc_type, value, count(*) AS pages, min(page_url) AS page_url FROM event_ind GROUP BY ioc_type, value",
    ),
    "actor_indicators": Query(
        lambda spark, sf: views.distinct_indicators(event_indicators(spark, sf), "actor"),
        f"WITH {EVENT_INDICATORS_SQL} SELECT ioc_type, value, count(*) AS pages, min(page_url) AS page_url FROM event_ind WHERE ioc_type IN ('btc', 'eth', 'xmr', 'handle', 'pgp_fp', 'contact_email', 'jabber') GROUP BY ioc_type, value",
    ),
    "collection_quality": Query(
        _quality,
        f"""WITH {EVENTS_SQL}, {CAPTURE_PAGES_SQL},
        k AS (SELECT *, (body_truncated = false AND content_sha256 IS NOT NULL) AS complete FROM capture_pages WHERE NOT blocked AND content IS NOT NULL),
        m AS (SELECT count(*) AS retained_pages, count(*) FILTER (complete) AS complete_captures, count(DISTINCT CASE WHEN complete THEN content_sha256 END) AS unique_complete_bodies,
          count(DISTINCT CASE WHEN complete AND length(trim(content)) >= 80 THEN content_sha256 END) AS unique_substantive_pages,
          count(*) FILTER (content_captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS fresh_within_7_days, count(*) FILTER (content_captured_at IS NULL) AS capture_date_unknown,
          count(*) FILTER (extraction_errors IS NOT NULL AND extraction_errors <> '[]') AS pages_with_extraction_errors, count(*) FILTER (extraction_errors IS NULL) AS extraction_status_unknown FROM k)
        SELECT *, complete_captures - unique_complete_bodies AS duplicate_pages, CASE WHEN complete_captures > 0 THEN round((complete_captures - unique_complete_bodies) / complete_captures, 4) END AS duplicate_rate,
          retained_pages - fresh_within_7_days - capture_date_unknown AS older_than_7_days, retained_pages - complete_captures AS truncated_or_unknown FROM m""",
    ),
    "duplicate_captures": Query(
        _duplicates,
        f"""WITH {EVENTS_SQL}, {CAPTURE_PAGES_SQL},
        e AS (SELECT content_sha256, url, row_number() OVER (PARTITION BY content_sha256 ORDER BY url) AS r, count(*) OVER (PARTITION BY content_sha256) AS copies
          FROM capture_pages WHERE NOT blocked AND content_sha256 IS NOT NULL AND body_truncated = false)
        SELECT content_sha256, copies, count(*) AS listed, min(url) AS first_url, max(url) AS last_url FROM e WHERE copies > 1 AND r <= 100 GROUP BY ALL""",
    ),
    "duplicate_documents": Query(
        _document_duplicates,
        f"""WITH {DOCUMENT_PAGES_SQL}, e AS (SELECT content_sha256, url, row_number() OVER (PARTITION BY content_sha256 ORDER BY url) AS r, count(*) OVER (PARTITION BY content_sha256) AS copies FROM document_pages)
        SELECT content_sha256, copies, string_agg(url, ' ' ORDER BY url) AS urls FROM e WHERE copies > 1 AND r <= 100 GROUP BY ALL""",
    ),
    "embedding_coverage": Query(
        _coverage,
        f"""WITH {DOCUMENT_PAGES_SQL}, v AS (SELECT 'http://src' || (vec_id % 20) || '.onion/d' || vec_id AS page_url, CASE WHEN label < 5 THEN 'hashing-64' ELSE 'older-64' END AS model, len(embedding) AS dim FROM embeddings)
        SELECT model, dim, count(*) AS pages, model = 'hashing-64' AND dim = 64 AS usable FROM v WHERE page_url IN (SELECT url FROM document_pages) GROUP BY model, dim""",
    ),
    "recent_timeline": Query(
        _recent_timeline,
        f"""WITH {EVENTS_SQL} SELECT event_id, kind, page_url, {_TS.format('occurred_at')} AS occurred_at FROM (SELECT * FROM timeline
        WHERE hostname = 'h3.example' AND kind IN ('page_unreachable', 'page_recovered', 'page_dead', 'indicator_new') ORDER BY timeline.occurred_at DESC, event_id DESC LIMIT 100)""",
    ),
    "page_listing": Query(
        _pages, f"WITH {STATE_SQL} SELECT url, status, attempts FROM state WHERE status = 'crawled' AND hostname = 'h5.example' ORDER BY url LIMIT 5 OFFSET 2"
    ),
    "work_waiting": Query(
        _waiting,
        f"WITH {STATE_SQL} SELECT count(*) FILTER (status = 'discovered') AS queued, count(*) FILTER (status = 'crawled' AND next_crawl_at <= TIMESTAMP '{AS_OF}') AS due FROM state",
    ),
    "work_waiting_scoped": Query(
        _waiting_scoped,
        f"""WITH {STATE_SQL} SELECT count(*) FILTER (s AND status = 'discovered') AS queued, count(*) FILTER (s AND status IN ('crawled', 'dead')) AS due
        FROM (SELECT *, next_crawl_at <= TIMESTAMP '2024-01-30 18:00:00' AND length(url) % 3 <= 1 AND hostname IN ('h1.example', 'h2.example', 'h11.example', 'h13.example') AS s FROM state)""",
    ),
}
