"""Table schemas (as DDL strings) and the enumerations that drive operator semantics."""

# Identifier types that may link two pages to one operator.
STRONG_TYPES = ("btc", "eth", "xmr", "handle", "pgp_fp", "contact_email", "jabber")

# Timeline event kinds.
PAGE_NEW = "page_new"
PAGE_CHANGED = "page_changed"
PAGE_UNREACHABLE = "page_unreachable"
PAGE_RECOVERED = "page_recovered"
PAGE_DEAD = "page_dead"
INDICATOR_NEW = "indicator_new"
ALL_KINDS = (PAGE_NEW, PAGE_CHANGED, PAGE_UNREACHABLE, PAGE_RECOVERED, PAGE_DEAD, INDICATOR_NEW)
NOTABLE_KINDS = (PAGE_UNREACHABLE, PAGE_RECOVERED, PAGE_DEAD, INDICATOR_NEW)
OUTAGE_KINDS = (PAGE_UNREACHABLE, PAGE_DEAD)

# Content-type prefixes treated as media.
MEDIA_PREFIXES = (
    "image/",
    "video/",
    "audio/",
    "application/octet-stream",
    "application/pdf",
    "application/zip",
    "application/x-",
)


CAPTURES = (
    "capture_id BIGINT, page_url STRING, hostname STRING, fetched_at TIMESTAMP, ok BOOLEAN, "
    "content_sha256 STRING, blocked BOOLEAN, title STRING, content STRING, body_truncated BOOLEAN, "
    "http_status INT, error STRING"
)
INDICATORS = ("page_url STRING, ioc_type STRING, value STRING, context STRING")
CREDENTIALS = ("page_url STRING, email STRING, domain STRING, password_sha256 STRING")
LISTINGS = (
    "page_url STRING, product STRING, vendor STRING, price DOUBLE, currency STRING, context STRING"
)
WATCHLISTS = (
    "watchlist_id BIGINT, name STRING, kind STRING, value STRING, webhook_url STRING, active BOOLEAN"
)
REVIEWS = (
    "pair_key STRING, left_type STRING, left_value STRING, right_type STRING, right_value STRING, "
    "verdict STRING, reason STRING, reviewer STRING, reviewed_at TIMESTAMP"
)
RUNS = (
    "run_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, heartbeat_at TIMESTAMP, "
    "trigger STRING, pages_crawled BIGINT, pages_dead BIGINT, iocs_found BIGINT, events_emitted BIGINT, "
    "new_alerts BIGINT, actors BIGINT, processing_errors BIGINT, queued_at_start BIGINT, "
    "due_at_start BIGINT, error STRING"
)
VERSIONS = (
    "version_id BIGINT, page_url STRING, captured_at TIMESTAMP, title STRING, content STRING, "
    "raw_body BINARY, body_sha256 STRING, body_truncated BOOLEAN, legacy BOOLEAN"
)
SOURCE_PACK = (
    "name STRING, description STRING, category STRING, version STRING, "
    "sources ARRAY<STRUCT<url: STRING, note: STRING, last_seen: STRING, evidence: STRING>>"
)
REVIEWED_EXAMPLES = (
    "schema_version INT, examples ARRAY<STRUCT<review_id: BIGINT, extractor: STRING, expected: STRING, "
    "verdict: STRING, text: STRING, body_sha256: STRING, reason: STRING>>"
)
PARSED_PAGE = (
    "title STRING, description STRING, keywords STRING, text STRING, "
    "links ARRAY<STRUCT<url: STRING, anchor_text: STRING>>, blocks ARRAY<STRING>"
)
