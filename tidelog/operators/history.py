"""Stored versions, retention, run health and the audit chain."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import audit_digest
from ..functions.ordered import id_chunk, previous_row, top_rows
from ..functions.text import humanize, seconds_between
from ..session import Scratch

STALL_THRESHOLD = 2
RECENT_PASSES = 10


# --- versions -----------------------------------------------------------------------------------------------------


def retained_versions(versions: DataFrame, cited: DataFrame, blocked_pages: DataFrame, keep: int = 20) -> DataFrame:
    """Newest ``keep`` versions of each page plus cited ones; a blocked page keeps none.

    Only keys are ranked; bodies join back afterwards.
    """
    allowed = versions.join(blocked_pages.select("page_url"), "page_url", "left_anti")
    newest = top_rows(allowed.select("page_url", "version_id"), ["page_url"], [F.desc("version_id")], keep).select("version_id")
    wanted = newest.unionByName(cited.select("version_id")).distinct()
    return allowed.join(wanted, "version_id", "left_semi")


def describe_versions(versions: DataFrame) -> DataFrame:
    """Listing columns without the bodies."""
    return versions.select(
        "version_id", "page_url", "title", "captured_at", "body_sha256", F.col("raw_body").isNotNull().alias("body_retained"), "body_truncated", "legacy"
    )


def version_listing(versions: DataFrame, url: str, limit: int = 50) -> DataFrame:
    return describe_versions(versions.filter(F.col("page_url") == url)).orderBy(F.desc("version_id")).limit(limit)


def version_changes(versions: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Lines added and removed between consecutive versions of every page, as often as they were, over whole texts.

    Lines count as a multiset: a line that stands twice and then once was removed once.  ``moved`` marks versions whose texts
    differ although no line was added or removed.  Versions are paired by their ids; the two texts of a pair join afterwards.
    """
    keys = versions.select("page_url", "version_id")
    paired = previous_row(keys, ["page_url"], ["version_id"], chunk if chunk is not None else id_chunk("version_id"), ["version_id"], "before")
    paired = paired.filter(F.col("before").isNotNull()).select("page_url", F.col("before.version_id").alias("before_id"), F.col("version_id").alias("after_id"))
    texts = versions.select("version_id", F.coalesce("content", F.lit("")).alias("content"))
    both = paired.join(texts.select(F.col("version_id").alias("before_id"), F.col("content").alias("_old")), "before_id")
    both = both.join(texts.select(F.col("version_id").alias("after_id"), F.col("content").alias("_new")), "after_id")
    difference = F.pandas_udf(_line_difference, "added array<string>, removed array<string>").asNondeterministic()
    both = both.withColumn("_d", difference("_old", "_new"))
    moved = (F.size("_d.added") == 0) & (F.size("_d.removed") == 0) & (F.col("_old") != F.col("_new"))
    return both.select("page_url", "before_id", "after_id", "_d.added", "_d.removed", moved.alias("moved"))


def _line_difference(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for olds, news in batches:
        rows = []
        for old, new in zip(olds, news, strict=True):
            was, now = (Counter(re.split(r"\r\n|\n|\r", text)) for text in (old, new))
            rows.append((list((now - was).elements()), list((was - now).elements())))
        yield pd.DataFrame(rows, columns=["added", "removed"])


# --- retention ----------------------------------------------------------------------------------------------------


def expired_pages(state: DataFrame, as_of, retention_days: int) -> DataFrame:
    """Urls past retention; zero or fewer days keeps everything."""
    if retention_days <= 0:
        return state.select("url").limit(0)
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(retention_days)} DAYS")
    return state.filter(F.col("created_at") < cutoff).select("url")


def purge(tables: dict[str, DataFrame], state: DataFrame, as_of, retention_days: int) -> dict[str, DataFrame]:
    """The page table and its per-page tables without expired pages.  Timeline events are not passed in: they survive."""
    gone = expired_pages(state, as_of, retention_days)
    by_page = gone.select(F.col("url").alias("page_url"))
    kept = {name: df.join(by_page, "page_url", "left_anti") for name, df in tables.items()}
    kept["pages"] = state.join(gone, "url", "left_anti")
    return kept


def purge_stored(tables, names: Sequence[str], state: DataFrame, as_of, retention_days: int) -> tuple[DataFrame, DataFrame]:
    """``purge`` as storage work on ``PageTables``: every dependent table loses the rows of expired pages, bucket by bucket.

    Returns the page table that is left and a manifest ``(name, removed)``.  The page table goes last: a job that is lost before finds
    the same pages expired again.  A retention of no days keeps everything.
    """
    spark = state.sparkSession
    if retention_days <= 0:
        return state, spark.createDataFrame([(name, 0) for name in [*names, "pages"]], "name STRING, removed BIGINT")
    gone = Scratch(spark).cut(expired_pages(state, as_of, retention_days), "expired")
    pages = gone.select(F.col("url").alias("page_url"))
    removed = [(name, tables.replace(name, pages)["removed"]) for name in names]
    manifest = spark.createDataFrame([*removed, ("pages", gone.count())], "name STRING, removed BIGINT")
    return state.join(gone, "url", "left_anti"), manifest


def purge_runs(runs: DataFrame, as_of, keep_days: int = 30) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    return runs.filter(~F.coalesce(F.col("started_at") < cutoff, F.lit(False)))


# --- runs ---------------------------------------------------------------------------------------------------------


def _waiting() -> Column:
    return F.col("queued_at_start") + F.col("due_at_start")


def _stalled() -> Column:
    return (F.col("pages_crawled") == 0) & (_waiting() > 0)


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest passes with duration, waiting work and the stalled flag."""
    return (
        runs.orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(limit)
        .select(
            "run_id",
            "started_at",
            F.bround(seconds_between(F.col("finished_at"), F.col("started_at")), 1).alias("duration_s"),
            "status",
            "pages_crawled",
            _waiting().alias("work_waiting"),
            ((F.col("status") == "ok") & _stalled()).alias("stalled"),
        )
    )


def close_abandoned(runs: DataFrame, as_of, stale_after_s: int = 300) -> DataFrame:
    """Running passes whose heartbeat expired become abandoned."""
    now = F.lit(as_of).cast("timestamp")
    dead = (F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < now - F.expr(f"INTERVAL {int(stale_after_s)} SECONDS"))
    dead = F.coalesce(dead, F.lit(False))
    # Fixed value: the error text is output that readers of the run table match on.
    return runs.withColumn("_dead", dead).withColumns(
        {
            "status": F.when(F.col("_dead"), "abandoned").otherwise(F.col("status")),
            "finished_at": F.when(F.col("_dead"), now).otherwise(F.col("finished_at")),
            "error": F.when(F.col("_dead"), "abandoned - the process ended before the pass finished").otherwise(F.col("error")),
        }
    ).drop("_dead")


def events_per_run(events: DataFrame) -> DataFrame:
    return events.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))


def collection_health(runs: DataFrame, as_of, stale_after_s: int = 3600) -> DataFrame:
    """One verdict row: unknown, failing, stale, stalled, idle or ok.

    The window runs over the at most ten newest finished passes; the other inputs are partial aggregates.
    """
    now = F.lit(as_of).cast("timestamp")
    finished = ~F.col("status").isin("running", "abandoned")
    recent = runs.filter(finished).orderBy(F.desc("started_at"), F.desc("run_id")).limit(RECENT_PASSES)
    order = Window.orderBy(F.desc("started_at"), F.desc("run_id"))  # at most RECENT_PASSES rows
    marked = recent.withColumn("_n", F.row_number().over(order)).withColumn(
        "_broken", F.sum((~((F.col("status") == "ok") & _stalled())).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    last = marked.agg(
        F.count(F.lit(1)).alias("finished"),
        F.count_if(F.col("_broken") == 0).alias("consecutive_stalled"),
        F.max_by(F.struct("status", "pages_crawled", "error", _waiting().alias("waiting"), F.coalesce("finished_at", "started_at").alias("at")), -F.col("_n")).alias("last"),
    )
    running = F.col("status") == "running"
    open_runs = runs.agg(
        F.count_if(running).alias("in_progress"),
        F.count_if(F.col("status") == "abandoned").alias("abandoned"),
        F.min(F.when(running, F.coalesce("heartbeat_at", "started_at"))).alias("running_since"),
    )
    since = seconds_between(now, F.col("last.at"))
    running_for = F.coalesce(seconds_between(now, F.col("running_since")), F.lit(0.0))
    busy = F.col("in_progress") > 0
    status = (
        F.when((F.col("finished") == 0) & (F.col("abandoned") > 0), F.when(busy, "unknown").otherwise("failing"))
        .when(F.col("finished") == 0, "unknown")
        .when(F.col("last.status") == "error", "failing")
        .when(~busy & (since > stale_after_s), "stale")
        .when(busy & (running_for > stale_after_s), "stale")
        .when(F.col("consecutive_stalled") >= STALL_THRESHOLD, "stalled")
        .when((F.col("last.pages_crawled") == 0) & (F.col("last.waiting") == 0), "idle")
        .otherwise("ok")
    )
    return last.crossJoin(open_runs).select(  # one row by one row
        status.alias("status"),
        "in_progress",
        F.when(F.col("finished") == 0, F.lit(0).cast("bigint")).otherwise(F.col("consecutive_stalled")).alias("consecutive_stalled"),
        F.col("last.status").alias("last_status"),
        F.bround(since / 60, 1).alias("minutes_ago"),
        humanize(since).alias("age"),
        F.col("last.pages_crawled").alias("pages_crawled"),
        F.col("last.waiting").alias("work_waiting"),
    )


# --- audit --------------------------------------------------------------------------------------------------------


def check_audit_chain(entries: DataFrame, chunk_width: int = 1_000_000) -> DataFrame:
    """Per entry: does it link to its predecessor, and does its digest recompute?

    Entries are chunked by id; only one boundary row per chunk meets in a single ordered pass.
    """
    genesis = F.lit("0" * 64)
    linked = previous_row(entries, [], ["id"], id_chunk("id", chunk_width), ["entry_hash"], "_before")
    return linked.select(
        "id",
        "entry_hash",
        (F.col("previous_hash") == F.coalesce("_before.entry_hash", genesis)).alias("linked"),
        (F.col("entry_hash") == audit_digest(*[F.col(c) for c in ("previous_hash", "actor", "action", "detail", "at")])).alias("digest_ok"),
    )


def audit_verdict(checked: DataFrame) -> DataFrame:
    bad = ~(F.col("linked") & F.col("digest_ok"))
    return checked.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~F.col("linked")).alias("broken_links"),
        F.count_if(~F.col("digest_ok")).alias("bad_digests"),
        F.min(F.when(bad, F.col("id"))).alias("failed_id"),
        F.max_by("entry_hash", "id").alias("head_hash"),
    ).withColumn("valid", F.col("failed_id").isNull())
