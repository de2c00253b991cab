"""State views: liveness, sites, corpus counts, quality, duplicates and listings of stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import top_rows
from ..functions.predicates import complete_body, complete_capture, indicator_types, not_answering, retained, substantive
from ..schemas import NOTABLE_KINDS, OUTAGE_KINDS


def _count_if(condition):
    return F.count_if(F.coalesce(condition, F.lit(False)))


def host_liveness(state: DataFrame, timeline: DataFrame) -> DataFrame:
    """Per-host up / down / never / unknown, with the last outage seen by the event log."""
    failures = F.coalesce("consecutive_failures", F.lit(0))
    crawled = F.col("status") == "crawled"
    hosts = (
        state.filter(F.col("hostname").isNotNull())
        .groupBy("hostname")
        .agg(
            F.count(F.lit(1)).alias("known"),
            _count_if(crawled & (failures == 0)).alias("live"),
            _count_if(crawled & (failures > 0)).alias("failing"),
            _count_if(F.col("status") == "dead").alias("dead"),
            F.count("content_sha256").alias("answered"),
            F.max("fetched_at").alias("last_fetch"),
            F.max("content_changed_at").alias("last_change"),
        )
    )
    outages = (
        timeline.filter(F.col("kind").isin(*OUTAGE_KINDS) & F.col("hostname").isNotNull())
        .groupBy("hostname")
        .agg(F.max("occurred_at").alias("_outage"))
    )
    state_of = (
        F.when(F.col("live") > 0, "up")
        .when((F.col("failing") > 0) | ((F.col("dead") > 0) & (F.col("answered") > 0)), "down")
        .when(F.col("dead") > 0, "never")
        .otherwise("unknown")
    )
    return (
        hosts.join(outages, "hostname", "left")
        .withColumn("state", state_of)
        .select(
            F.col("hostname").alias("host"),
            "state",
            "known",
            "live",
            "failing",
            "dead",
            "last_fetch",
            "last_change",
            F.when(F.col("state") == "down", F.col("_outage")).alias("offline_since"),
        )
    )


def rank_liveness(liveness: DataFrame, limit: int = 200) -> DataFrame:
    """Down first, then up, never, unknown; larger hosts first; ties by host."""
    rank = F.when(F.col("state") == "down", 0).when(F.col("state") == "up", 1).when(F.col("state") == "never", 2).otherwise(3)
    return liveness.orderBy(rank, F.desc("known"), "host").limit(limit)


def sites(state: DataFrame, indicators: DataFrame) -> DataFrame:
    """Status pivot per host with indicator counts; hosts with any pinned page are marked."""
    status = F.col("status")
    failing = (status == "crawled") & not_answering()
    pinned = F.col("pinned") if "pinned" in state.columns else F.lit(False)
    # Indicators are reduced to one row per page before they meet the page table.
    per_page = indicators.groupBy(F.col("page_url").alias("url")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        state.filter(F.col("hostname").isNotNull())
        .join(per_page, "url", "left")
        .groupBy(F.col("hostname").alias("host"))
        .agg(
            _count_if(status == "crawled").alias("crawled"),
            _count_if(status == "discovered").alias("queued"),
            _count_if((status == "dead") | failing).alias("unreachable"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("iocs"),
            F.coalesce(F.bool_or(pinned), F.lit(False)).alias("pinned"),
        )
    )


def rank_sites(table: DataFrame, limit: int = 200) -> DataFrame:
    return table.orderBy(F.desc("crawled"), F.desc("iocs"), "host").limit(limit)


def pages_by_status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row per named table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def overview_counts(state: DataFrame, indicators: DataFrame) -> DataFrame:
    """Fetched, queued, unreachable pages; indicator sightings and distinct identifiers."""
    pages = state.agg(
        _count_if(retained()).alias("pages"),
        _count_if(F.col("status") == "discovered").alias("queued"),
        _count_if(not_answering()).alias("unreachable"),
    )
    found = indicators.groupBy("ioc_type", "value").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("iocs"), F.count(F.lit(1)).alias("unique_iocs")
    )
    return pages.crossJoin(found)  # one row by one row


def top_groups(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Non-null values by descending count; ties by value."""
    out = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "name")
    )
    return out.limit(limit) if limit else out


def recent_pages(state: DataFrame, limit: int = 8) -> DataFrame:
    return state.filter(F.col("status") == "crawled").orderBy(F.desc("fetched_at"), "url").limit(limit)


def distinct_indicators(indicators: DataFrame, types: str | None = None, value: str | None = None) -> DataFrame:
    """One row per identifier with its sightings and first page."""
    rows = indicators.filter(indicator_types(types))
    if value:
        rows = rows.filter(F.col("value") == value)
    return rows.groupBy("ioc_type", "value").agg(F.count(F.lit(1)).alias("pages"), F.min("page_url").alias("page_url"))


def collection_quality(state: DataFrame, as_of, fresh_days: int = 7) -> DataFrame:
    """Quality measures over retained captures.

    Bodies are first reduced to one row per hash, so the distinct counts need no second expansion.
    """
    kept, complete = retained(), complete_capture()
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(fresh_days)} DAYS")
    captured = F.col("content_captured_at")
    errors = F.col("extraction_errors") if "extraction_errors" in state.columns else F.lit(None).cast("string")
    per_body = state.groupBy(F.when(complete, F.col("content_sha256")).alias("body")).agg(
        _count_if(kept).alias("retained"),
        _count_if(complete).alias("complete"),
        F.max((complete & substantive()).cast("int")).alias("useful"),
        _count_if(kept & (captured >= cutoff)).alias("fresh"),
        _count_if(kept & captured.isNull()).alias("unknown"),
        _count_if(kept & errors.isNotNull() & (errors != "[]")).alias("errors"),
        _count_if(kept & errors.isNull()).alias("error_unknown"),
    )
    totals = per_body.agg(
        F.sum("retained").alias("retained_pages"),
        F.sum("complete").alias("complete_captures"),
        F.count("body").alias("unique_complete_bodies"),
        F.sum(F.when(F.col("body").isNotNull(), F.col("useful")).otherwise(0)).cast("bigint").alias("unique_substantive_pages"),
        F.sum("fresh").alias("fresh_within_7_days"),
        F.sum("unknown").alias("capture_date_unknown"),
        F.sum("errors").alias("pages_with_extraction_errors"),
        F.sum("error_unknown").alias("extraction_status_unknown"),
    )
    n, u = F.col("complete_captures"), F.col("unique_complete_bodies")
    return totals.withColumns(
        {
            "duplicate_pages": n - u,
            "duplicate_rate": F.bround(F.try_divide(n - u, n), 4),
            "older_than_7_days": F.col("retained_pages") - F.col("fresh_within_7_days") - F.col("capture_date_unknown"),
            "truncated_or_unknown": F.col("retained_pages") - n,
        }
    )


def copied_bodies(pages: DataFrame) -> DataFrame:
    """``(content_sha256, copies, url, hostname)``: every source of every complete body seen on more than one page.

    ``duplicate_groups`` is its short list.  Counts join by hash, so a body with very many sources is spread by adaptive execution.
    """
    eligible = pages.filter(F.coalesce(~F.col("blocked"), F.lit(False)) & complete_body())
    counts = eligible.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return eligible.select("content_sha256", "url", "hostname").join(counts, "content_sha256").select("content_sha256", "copies", "url", "hostname")


def duplicate_groups(pages: DataFrame, max_sources: int = 100) -> DataFrame:
    """Complete bodies seen on more than one page, with up to ``max_sources`` sources in url order.

    Sources are cut to ``max_sources`` per hash inside each task before they are gathered, so the array is bounded.
    """
    eligible = pages.filter(F.coalesce(~F.col("blocked"), F.lit(False)) & complete_body())
    counts = eligible.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    sources = (
        top_rows(eligible.select("content_sha256", "url", "hostname"), ["content_sha256"], [F.col("url")], max_sources)
        .groupBy("content_sha256")
        .agg(F.array_sort(F.collect_list(F.struct("url", "hostname"))).alias("sources"))
    )
    return counts.join(sources, "content_sha256")


def rank_duplicates(groups: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    return groups.orderBy(F.desc("copies"), "content_sha256").offset(offset).limit(limit)


def embedding_coverage(state: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors per (model, dim) of retained pages, marked usable or stale for the current embedder."""
    usable = (F.col("model") == model) & (F.col("dim") == dim)
    return (
        vectors.join(state.filter(retained()).select(F.col("url").alias("page_url")), "page_url", "left_semi")
        .groupBy("model", "dim")
        .agg(F.count(F.lit(1)).alias("pages"))
        .withColumn("usable", usable)
    )


def filter_timeline(
    timeline: DataFrame, kind: str | None = None, host: str | None = None, notable_only: bool = False, limit: int = 100
) -> DataFrame:
    rows = timeline
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if notable_only:
        rows = rows.filter(F.col("kind").isin(*NOTABLE_KINDS))
    if host:
        rows = rows.filter(F.col("hostname") == host)
    return rows.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def filter_pages(
    state: DataFrame,
    host: str | None = None,
    page_type: str | None = None,
    threat: str | None = None,
    status: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Filtered page listing in url order."""
    rows = state
    for column, wanted in (("hostname", host), ("page_type", page_type), ("threat_category", threat), ("status", status)):
        if wanted:
            rows = rows.filter(F.col(column) == wanted)
    return rows.orderBy("url").offset(offset).limit(limit)


def filter_listings(listings: DataFrame, vendor: str | None = None, max_price: float | None = None) -> DataFrame:
    rows = listings
    if vendor:
        rows = rows.filter(F.col("vendor") == vendor)
    if max_price is not None:
        rows = rows.filter(F.col("price") <= max_price)
    return rows


def breach_lookup(credentials: DataFrame, email: str | None = None, domain: str | None = None) -> DataFrame:
    """Sightings of a lower-cased address and/or domain; the stored hash is not returned."""
    if not email and not domain:
        raise ValueError("provide email or domain")
    rows = credentials
    if email:
        rows = rows.filter(F.col("email") == email.lower())
    if domain:
        rows = rows.filter(F.col("domain") == domain.lower())
    return rows.select("email", "domain", "page_url")


def breach_lookup_many(credentials: DataFrame, domains: DataFrame) -> DataFrame:
    """The same lookup against a customer list of domains."""
    wanted = domains.select(F.lower("domain").alias("domain")).distinct()
    return credentials.join(wanted, "domain", "left_semi").select("email", "domain", "page_url")


def page_detail(state: DataFrame, indicators: DataFrame, url: str) -> DataFrame:
    """One page with its indicators; both sides are filtered to the url before they meet."""
    found = (
        indicators.filter(F.col("page_url") == url)
        .groupBy(F.col("page_url").alias("url"))
        .agg(F.array_sort(F.collect_list(F.struct("ioc_type", "value", "context"))).alias("indicators"))
    )
    return state.filter(F.col("url") == url).join(found, "url", "left")


def hosts_known(state: DataFrame) -> DataFrame:
    """Known pages and pinned flag per host."""
    return (
        state.filter(F.col("hostname").isNotNull())
        .groupBy("hostname")
        .agg(F.count(F.lit(1)).alias("known"), F.coalesce(F.bool_or("pinned"), F.lit(False)).alias("pinned"))
    )


def work_waiting(state: DataFrame, as_of, max_depth: int | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Queued and due pages.  With a depth the scoped definition applies: both need a due time, dead pages count."""
    due = F.col("next_crawl_at") <= F.lit(as_of).cast("timestamp")
    status = F.col("status")
    if max_depth is None:
        queued, waiting = status == "discovered", (status == "crawled") & due
    else:
        scope = due & (F.col("depth") <= max_depth)
        if hosts:
            scope = scope & F.col("hostname").isin(*hosts)
        queued, waiting = scope & (status == "discovered"), scope & status.isin("crawled", "dead")
    return state.agg(_count_if(queued).alias("queued"), _count_if(waiting).alias("due"))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
