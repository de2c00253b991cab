"""Frontier planning: score discovered links, admit them under per-host caps, and pick the next fetch list."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hosts import hostname, scope_host
from ..session import small_table
from .search import hashed_vector, sparse_dot

DEAD_END_FACTOR, HIGH_VALUE_FACTOR, OFF_HOST_FACTOR = 0.05, 2.0, 0.1
MAX_DEPTH, HOST_CAP, PINNED_HOST_CAP = 5, 25, 100
PINNED_HOSTS_BROADCAST = 200_000

# Url parts that never lead to records, and parts where records concentrate.
DEAD_END = (
    r"(?iU)(?:^|[/_?&=-])(?:log[_-]?in|log[_-]?out|sign[_-]?in|sign[_-]?up|register|registration"
    r"|account|password|passwd|forgot|reset|captcha|cart|basket|checkout|terms|tos|privacy"
    r"|legal|imprint|about|careers?|jobs?|contact|faq|help|support|donate|rss|feed|sitemap"
    r"|.*\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|pdf|zip|gz|exe))(?:$|[/._?&=-])"
)
HIGH_VALUE = (
    r"(?iU)(?:^|[/_?&=-])(?:vendor|seller|shop|store|market|product|listing|listings|item|items"
    r"|offer|offers|cat|category|categories|catalog|profile|user|users|review|reviews"
    r"|feedback|pgp|escrow)(?:$|[/._?&=-])"
)


def keyword_score(anchor: Column, url: Column, words: Sequence[str]) -> Column:
    """1 plus the number of focus words contained in anchor text and url."""
    haystack = F.lower(F.concat(F.coalesce(anchor, F.lit("")), F.lit(" "), url))
    score = F.lit(1.0)
    for word in words:
        if word.strip():
            score = score + haystack.contains(word.lower()).cast("double")
    return score


def structural_prior(url: Column) -> Column:
    """Factor by the words of the url; where both kinds of words occur, the lower factor holds."""
    return F.when(url.rlike(DEAD_END), DEAD_END_FACTOR).when(url.rlike(HIGH_VALUE), HIGH_VALUE_FACTOR).otherwise(1.0)


def centroid_score(anchor: Column, url: Column, centroid: Column, dim: int) -> Column:
    """1 plus the positive part of the cosine between a link's hashed vector and the focus centroid (a bucket map)."""
    text = F.concat(F.coalesce(anchor, F.lit("")), F.lit(" "), url)
    return F.lit(1.0) + F.greatest(F.lit(0.0), sparse_dot(hashed_vector(text, dim), centroid))


def score_links(
    links: DataFrame, pinned_hosts: DataFrame, relevance: Column, off_host_factor: float = OFF_HOST_FACTOR, structural: bool = True
) -> DataFrame:
    """Add ``score``.  ``links``: ``url, anchor_text, targeted``; ``pinned_hosts``: ``hostname``.

    Links of a targeted lineage that leave the pinned hosts are demoted, never dropped.
    """
    pins = small_table(pinned_hosts.select(F.col("hostname").alias("_pin")).distinct(), PINNED_HOSTS_BROADCAST)
    joined = links.join(pins, hostname(F.col("url")) == F.col("_pin"), "left")
    off_host = F.coalesce("targeted", F.lit(False)) & F.col("_pin").isNull()
    base = relevance * structural_prior(F.col("url")) if structural else relevance
    return joined.withColumn("score", F.when(off_host, base * off_host_factor).otherwise(base)).drop("_pin")


def discovered(
    links: DataFrame, max_depth: int = MAX_DEPTH, threshold: float = 0.0, allow_clearnet: bool = False, allowed_hosts: list[str] | None = None
) -> DataFrame:
    """Children worth queueing.  ``links`` carry the parent's ``depth``; the result carries the child's.

    Filters run before any ranking, so the shuffle that follows only sees admissible links.
    """
    rows = with_scope_host(links.filter((F.col("score") >= threshold) & (F.col("depth") < max_depth)))
    rows = rows.filter(F.col("scope_host").isin(*allowed_hosts) if allowed_hosts else F.col("scope_host").isNotNull())
    if not allow_clearnet:
        rows = rows.filter(F.col("scope_host").endswith(".onion"))
    return rows.drop("scope_host").withColumn("depth", F.col("depth") + 1)


def _ascii_urls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Urls with their hosts in IDNA form; null where a host cannot be encoded."""
    pattern = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?)([^:/?#]*)(.*)$", re.S)

    def one(url: str | None) -> str | None:
        found = pattern.match(url) if url else None
        if not found:
            return None
        try:
            return found[1] + found[2].rstrip(".").encode("idna").decode().lower() + found[3]
        except UnicodeError:
            return None

    for batch in batches:
        yield pd.Series([one(url) for url in batch], index=batch.index, dtype="object")


def with_scope_host(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add ``scope_host``, the canonical ASCII host of an acceptable url, else null; hosts outside ASCII go through IDNA.

    Python only sees urls with a letter outside ASCII.
    """
    plain = F.col(url).rlike(r"^[\x00-\x7f]*$")
    encoded = rows.withColumn("_ascii_url", F.pandas_udf(_ascii_urls, "string")(F.when(~plain & (F.length(url) <= 2048), F.col(url))))
    spelled = F.coalesce("_ascii_url", F.when(plain, F.col(url)))
    return encoded.withColumn("_spelled", spelled).withColumn("scope_host", scope_host(F.col("_spelled"))).drop("_ascii_url", "_spelled")


def admit(
    candidates: DataFrame, known: DataFrame, host_cap: int = HOST_CAP, pinned_cap: int = PINNED_HOST_CAP, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """New pages that fit under their host's cap, in discovery order.

    ``candidates``: ``url, parent_url, depth, score, targeted, position`` (position orders discovery); ``known``:
    ``url, hostname, pinned``.  A url found several times counts once, at its first position.  A cap of zero is no cap.
    """
    place = F.struct("position", "parent_url")
    first = (
        with_scope_host(candidates.filter(F.col("depth") <= max_depth))
        .filter(F.col("scope_host").isNotNull())
        .groupBy("url")
        .agg(F.min_by(F.struct("parent_url", "depth", "score", "targeted"), place).alias("c"), F.min(place).alias("place"), F.any_value("scope_host").alias("hostname"))
    )
    fresh = first.join(known.select("url"), "url", "left_anti")
    hosts = known.groupBy("hostname").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or("pinned"), F.lit(False)).alias("_pinned"))
    limits = hosts.select("hostname", "_n", F.when(F.col("_pinned"), pinned_cap).otherwise(host_cap).alias("_cap"))
    # Each host has its own cap; zero means none.  Where both are set, a task keeps at most the larger many rows of a host.
    order = Window.partitionBy("hostname").orderBy("place", "url")
    ranked = fresh.withColumn("_r", F.row_number().over(order))
    if host_cap and pinned_cap:
        ranked = ranked.filter(F.col("_r") <= max(host_cap, pinned_cap))
    joined = ranked.join(limits, "hostname", "left")
    cap = F.coalesce("_cap", F.lit(host_cap))
    room = cap - F.coalesce("_n", F.lit(0))
    return joined.filter((cap == 0) | (F.col("_r") <= room)).select("url", "hostname", "c.*")


def rediscover(state: DataFrame, candidates: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Known pages found again at a smaller depth take the new depth and parent, unless they are being fetched."""
    best = (
        candidates.filter(F.col("depth") <= max_depth)
        .groupBy("url")
        .agg(F.min(F.struct("depth", "position", "parent_url")).alias("b"))
    )
    joined = state.join(best, "url", "left")
    shallower = F.coalesce((F.col("status") != "in_progress") & (F.col("b.depth") < F.col("depth")), F.lit(False))
    return joined.withColumns(
        {
            "parent_url": F.when(shallower, F.col("b.parent_url")).otherwise(F.col("parent_url")),
            "depth": F.when(shallower, F.col("b.depth")).otherwise(F.col("depth")),
        }
    ).drop("b")


def eligible(as_of, max_depth: int = MAX_DEPTH, reclaim_after_s: int = 300, hosts: list[str] | None = None) -> Column:
    """Due pages, and claims whose worker went silent.  A null due time never qualifies."""
    now = F.lit(as_of).cast("timestamp")
    due = F.col("status").isin("discovered", "crawled", "dead") & (F.col("next_crawl_at") <= now)
    stale = (F.col("status") == "in_progress") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {int(reclaim_after_s)} SECONDS"))
    ready = (due | stale) & (F.col("depth") <= max_depth)
    if hosts:
        ready = ready & F.col("hostname").isin(*hosts)
    return F.coalesce(ready, F.lit(False))


def next_batch(state: DataFrame, as_of, budget: int, **rules) -> DataFrame:
    """The next fetch list: best score, then shallowest, then oldest."""
    return (
        state.filter(eligible(as_of, **rules))
        .orderBy(F.desc("score"), "depth", "created_at", "url")
        .limit(budget)
    )


def rescore(state: DataFrame, pinned_hosts: DataFrame, words: Sequence[str] = (), off_host_factor: float = OFF_HOST_FACTOR) -> DataFrame:
    """New scores of queued pages whose score changes; fetched pages keep theirs."""
    queued = state.filter(F.col("status") == "discovered").withColumnRenamed("score", "old_score").withColumn("anchor_text", F.lit(""))
    scored = score_links(queued, pinned_hosts, keyword_score(F.col("anchor_text"), F.col("url"), words), off_host_factor)
    return scored.filter(F.col("old_score").isNull() | (F.abs(F.col("score") - F.col("old_score")) > 1e-9)).select("url", "old_score", "score")


def requeue(state: DataFrame, requested: DataFrame, as_of) -> DataFrame:
    """Make requested pages due now; pages being fetched are left alone."""
    asked = requested.select("url").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce("_asked", F.lit(False)) & (F.col("status") != "in_progress")
    status = F.when(F.col("content_sha256").isNotNull(), "crawled").otherwise("discovered")
    return (
        state.join(asked, "url", "left")
        .withColumn("_hit", hit)
        .withColumns(
            {
                "status": F.when(F.col("_hit"), status).otherwise(F.col("status")),
                "next_crawl_at": F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("next_crawl_at")),
                "consecutive_failures": F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("consecutive_failures")).cast("bigint"),
                "depth": F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("depth")),
                "parent_url": F.when(~F.col("_hit"), F.col("parent_url")),
            }
        )
        .drop("_asked", "_hit")
    )


def clear_queue(state: DataFrame) -> DataFrame:
    """Drop links that were discovered but never fetched."""
    return state.filter(F.col("status") != "discovered")


def scope_preview(state: DataFrame, max_depth: int, hosts: list[str] | None = None) -> DataFrame:
    rows = state.filter(F.col("depth") <= max_depth)
    if hosts:
        rows = rows.filter(F.col("hostname").isin(*hosts))
    return rows.agg(F.count(F.lit(1)).alias("pages"))


def _idna(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str | None] = {}
    for batch in batches:
        for host in batch.dropna().unique():
            if host not in known:
                try:
                    known[host] = host.rstrip(".").encode("idna").decode().lower()
                except UnicodeError:
                    known[host] = None
        yield pd.Series([known.get(host) for host in batch], index=batch.index, dtype="object")


def idna_hosts(hosts: DataFrame, column: str = "hostname") -> DataFrame:
    """Add ``ascii_host``: ASCII hosts as they are, others through IDNA (null when not encodable).

    Python sees null for every ASCII host, so a batch of them costs next to nothing and nothing is shuffled.
    """
    foreign = ~F.col(column).rlike(r"^[\x00-\x7f]*$")
    plain = F.lower(F.regexp_replace(column, r"\.+$", ""))
    encode = F.pandas_udf(_idna, "string")
    encoded = hosts.withColumn("_ascii", encode(F.when(foreign, F.col(column))))
    return encoded.withColumn("ascii_host", F.when(foreign, F.col("_ascii")).otherwise(plain)).drop("_ascii")
