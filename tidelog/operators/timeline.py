"""Change, outage and recrawl state derived from an append-only capture log.

The log is one row per fetch observation.  All per-page order is resolved by a chunked scan: rows are shuffled once by
``(page_url, time chunk)``; each chunk yields one summary row; summaries are scanned per page to give every chunk the
state it starts from.  A page with a third of all captures is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import BEFORE, UP_TO, previous_row, time_chunk
from ..schemas import (
    INDICATOR_NEW,
    PAGE_CHANGED,
    PAGE_DEAD,
    PAGE_NEW,
    PAGE_RECOVERED,
    PAGE_UNREACHABLE,
    STRONG_TYPES,
)

BACKFILL_MARK = "reconstructed from stored page state"
EVENT_ID_STRIDE = 10_000


def _same(a: Column, b: Column) -> Column:
    return a["sha"].eqNullSafe(b["sha"]) & a["blocked"].eqNullSafe(b["blocked"])


def annotate(
    captures: DataFrame,
    base_s: float = 86_400,
    max_s: float = 604_800,
    max_failures: int = 3,
    chunk_unit: str = "day",
) -> DataFrame:
    """Add per-capture state: ``changed, is_first, recovered, went_down, is_dead, fails, streak, interval_s, prev_title``.

    An optional boolean column ``forced`` marks observations requested by a re-queue, which zeroes the failure count
    beforehand without touching the outage state.
    """
    local = _inside_chunks(captures, chunk_unit)
    return _resolved(local.join(_carried(_summaries(local)), ["page_url", "_chunk"]), captures.columns, base_s, max_s, max_failures)


def _inside_chunks(captures: DataFrame, chunk_unit: str) -> DataFrame:
    """Every capture with what its own ``(page_url, _chunk)`` says about it."""
    has_forced = "forced" in captures.columns
    ok = F.coalesce("ok", F.lit(False))
    rows = captures.withColumns(
        {
            "_chunk": time_chunk("fetched_at", chunk_unit),
            "ok": ok,
            "_forced": F.coalesce("forced", F.lit(False)) if has_forced else F.lit(False),
            "_now": F.when(
                ok,
                F.struct(
                    F.col("content_sha256").alias("sha"),
                    F.coalesce("blocked", F.lit(False)).alias("blocked"),
                    F.col("title").alias("title"),
                ),
            ),
        }
    )
    inside = Window.partitionBy("page_url", "_chunk").orderBy("fetched_at", "capture_id")
    before, upto = inside.rowsBetween(*BEFORE), inside.rowsBetween(*UP_TO)
    known_prev = F.col("_local_prev").isNotNull()
    repeats = known_prev & F.col("ok") & _same(F.col("_now"), F.col("_local_prev"))
    differs = known_prev & F.col("ok") & ~_same(F.col("_now"), F.col("_local_prev"))
    return (
        rows.withColumns(
            {
                "_local_prev": F.last("_now", ignorenulls=True).over(before),
                "_local_obs": F.lag("ok").over(inside),
                "_fail_sum": F.sum((~F.col("ok")).cast("bigint")).over(upto),
            }
        )
        .withColumns(
            {
                "_same_sum": F.sum(repeats.cast("bigint")).over(upto),
                "_fail_mark": F.last(
                    F.when(F.col("ok"), F.col("_fail_sum")).when(F.col("_forced"), F.col("_fail_sum") - 1),
                    ignorenulls=True,
                ).over(upto),
            }
        )
        .withColumn("_same_mark", F.last(F.when(differs, F.col("_same_sum")), ignorenulls=True).over(upto))
    )


def _summaries(local: DataFrame) -> DataFrame:
    """One row per ``(page_url, _chunk)`` that says all a later chunk needs to know of it."""
    when = F.struct("fetched_at", "capture_id")
    return local.groupBy("page_url", "_chunk").agg(
        F.max("_fail_sum").alias("n_fail"),
        F.max("_same_sum").alias("n_same"),
        F.max_by("_fail_mark", when).alias("fail_mark"),
        F.max_by("_same_mark", when).alias("same_mark"),
        F.min_by("_now", F.when(F.col("ok"), when)).alias("first_ok"),
        F.max_by("_now", F.when(F.col("ok"), when)).alias("last_ok"),
        F.max_by("ok", when).alias("last_obs"),
    )


CARRIED = ("c_prev", "c_obs", "c_fail", "c_fail_mark", "c_first_same", "c_same", "c_same_mark")


def _carried(summary: DataFrame) -> DataFrame:
    """The state in which every chunk of a page begins."""
    page = Window.partitionBy("page_url").orderBy("_chunk")
    prior = page.rowsBetween(*BEFORE)
    first_same = F.coalesce(
        F.col("c_prev").isNotNull() & F.col("first_ok").isNotNull() & _same(F.col("first_ok"), F.col("c_prev")), F.lit(False)
    ).cast("bigint")
    mark_at = F.when(F.col("same_mark").isNotNull(), F.col("c_same") + F.col("c_first_same") + F.col("same_mark")).when(
        F.col("first_ok").isNotNull() & (F.col("c_first_same") == 0), F.col("c_same")
    )
    return (
        summary.withColumns(
            {
                "c_prev": F.last("last_ok", ignorenulls=True).over(prior),
                "c_obs": F.lag("last_obs").over(page),
                "c_fail": F.coalesce(F.sum("n_fail").over(prior), F.lit(0)),
            }
        )
        .withColumns(
            {
                "c_first_same": first_same,
                "c_fail_mark": F.last(F.col("c_fail") + F.col("fail_mark"), ignorenulls=True).over(prior),
            }
        )
        .withColumn("c_same", F.coalesce(F.sum(F.col("n_same") + F.col("c_first_same")).over(prior), F.lit(0)))
        .withColumn("c_same_mark", F.last(mark_at, ignorenulls=True).over(prior))
        .select("page_url", "_chunk", *CARRIED)
    )


def _resolved(full: DataFrame, columns: list[str], base_s: float, max_s: float, max_failures: int) -> DataFrame:
    """Flags and counters from a chunk's own view and the state in which it begins."""
    known_prev = F.col("_local_prev").isNotNull()
    prev = F.coalesce("_local_prev", "c_prev")
    seen_ok = F.col("ok") | known_prev
    same_sum = F.col("c_same") + F.col("_same_sum") + F.when(seen_ok, F.col("c_first_same")).otherwise(0)
    same_mark = (
        F.when(F.col("_same_mark").isNotNull(), F.col("c_same") + F.col("c_first_same") + F.col("_same_mark"))
        .when(seen_ok & (F.col("c_first_same") == 0), F.col("c_same"))
        .otherwise(F.coalesce("c_same_mark", F.lit(0)))
    )
    fails = F.col("c_fail") + F.col("_fail_sum") - F.coalesce(
        F.col("c_fail") + F.col("_fail_mark"), F.col("c_fail_mark"), F.lit(0)
    )
    had = F.col("_prev").isNotNull()
    out = (
        full.withColumns(
            {"_prev": prev, "_prev_obs": F.coalesce("_local_obs", "c_obs"), "fails": fails, "streak": same_sum - same_mark}
        )
        .withColumns(
            {
                "is_first": F.col("ok") & ~had,
                "changed": F.col("ok") & (~had | ~_same(F.col("_now"), F.col("_prev"))),
                "recovered": F.col("ok") & had & ~F.coalesce("_prev_obs", F.lit(True)),
                "went_down": ~F.col("ok") & had & F.coalesce("_prev_obs", F.lit(False)),
                "is_dead": ~F.col("ok") & (F.lit(base_s <= 0) | (F.col("fails") >= max_failures)),
                "ever_ok": F.col("ok") | had,
                "prev_title": F.col("_prev.title"),
            }
        )
        .withColumn("interval_s", _next_interval(base_s, max_s))
    )
    return out.select(
        *columns,
        "changed",
        "is_first",
        "recovered",
        "went_down",
        "is_dead",
        "ever_ok",
        "fails",
        "streak",
        "interval_s",
        "prev_title",
    )


NOTES = ("changed", "is_first", "recovered", "went_down", "is_dead", "ever_ok", "fails", "streak", "interval_s", "prev_title")


def chunk_summaries(captures: DataFrame, chunk_unit: str = "day") -> DataFrame:
    """The summaries that ``repair`` keeps beside an annotated log."""
    return _summaries(_inside_chunks(captures, chunk_unit))


def repair(
    annotated: DataFrame, summaries: DataFrame, late: DataFrame, base_s: float = 86_400, max_s: float = 604_800, max_failures: int = 3, chunk_unit: str = "day"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Work captures that came too late into an annotated log; returns rows to put in, chunks they replace, and new summaries.

    ``late`` has the columns of the captures; rows that the log holds already, or that repeat, change nothing.  Only chunks with a
    late row are scanned again.  The summaries of their pages are then carried on, and of the other chunks only those are resolved
    again that begin in another state than before: a page that converges after a day costs that day.
    """
    key = ["page_url", "_chunk"]
    columns = [c for c in annotated.columns if c not in NOTES]
    stored = annotated.select(*columns).withColumn("_chunk", time_chunk("fetched_at", chunk_unit))
    fresh = late.select(*columns).dropDuplicates(["page_url", "capture_id"]).join(annotated.select("page_url", "capture_id"), ["page_url", "capture_id"], "left_anti")
    fresh = fresh.select(*columns).withColumn("_chunk", time_chunk("fetched_at", chunk_unit))
    touched = fresh.select(*key).distinct()
    rows = stored.join(touched, key, "left_semi").unionByName(fresh)
    local = _inside_chunks(rows.drop("_chunk"), chunk_unit)
    own = summaries.join(touched.select("page_url").distinct(), "page_url", "left_semi")
    again = own.join(touched, key, "left_anti").unionByName(_summaries(local))
    then, now = _carried(own), _carried(again)
    before = then.select(*key, F.struct(*CARRIED).alias("_then"))
    moved = now.withColumn("_now", F.struct(*CARRIED)).join(before, key, "left").filter(~F.col("_now").eqNullSafe(F.col("_then"))).select(*key)
    wanted = moved.unionByName(touched).distinct()
    other = wanted.join(touched, key, "left_anti")
    rest = _inside_chunks(stored.join(other, key, "left_semi").drop("_chunk"), chunk_unit)
    full = local.unionByName(rest).join(now, key)
    return _resolved(full, columns, base_s, max_s, max_failures), wanted, again


def repaired(annotated: DataFrame, changed: DataFrame, chunks: DataFrame, chunk_unit: str = "day") -> DataFrame:
    """The annotated log with the rows of ``chunks`` replaced by ``changed``."""
    kept = annotated.withColumn("_chunk", time_chunk("fetched_at", chunk_unit)).join(chunks, ["page_url", "_chunk"], "left_anti").drop("_chunk")
    return kept.select(*changed.columns).unionByName(changed)


def _next_interval(base_s: float, max_s: float) -> Column:
    """Seconds until the next fetch, null when none is due (blocked, dead, or recrawl disabled)."""
    if base_s <= 0:
        return F.lit(None).cast("double")
    steady = F.when(F.col("streak") == 0, F.lit(float(base_s))).otherwise(
        F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), F.least("streak", F.lit(62))), F.lit(float(max_s)))
    )
    backoff = F.least(F.lit(float(base_s)) * F.col("fails"), F.lit(float(max_s)))
    return F.when(F.col("ok"), F.when(~F.coalesce("blocked", F.lit(False)), steady)).otherwise(
        F.when(~F.col("is_dead"), backoff)
    )


def page_events(annotated: DataFrame) -> DataFrame:
    """One row per page transition, in the order the transitions apply within a capture."""
    name = F.coalesce("title", "prev_title", "page_url")
    stored_name = F.coalesce("prev_title", "page_url")

    def event(flag: Column, seq: int, kind: str, summary: Column, detail: Column | None = None) -> Column:
        return F.when(
            flag,
            F.struct(
                F.lit(seq).alias("seq"),
                F.lit(kind).alias("kind"),
                summary.substr(1, 512).alias("summary"),
                (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
            ),
        )

    error = F.col("error") if "error" in annotated.columns else F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            # The summaries are output that readers of the timeline match on.
            event(F.col("went_down"), 1, PAGE_UNREACHABLE, F.concat(F.lit("Stopped responding: "), stored_name), error),
            event(
                F.col("is_dead"),
                2,
                PAGE_DEAD,
                F.concat(F.lit("Given up after "), F.col("fails").cast("string"), F.lit(" failed fetch(es): "), F.col("page_url")),
                error,
            ),
            event(F.col("recovered"), 3, PAGE_RECOVERED, F.concat(F.lit("Back online: "), stored_name)),
            event(F.col("is_first"), 4, PAGE_NEW, F.concat(F.lit("New page: "), F.coalesce("title", "page_url"))),
            event(
                F.col("changed") & ~F.col("is_first"), 5, PAGE_CHANGED, F.concat(F.lit("Content changed: "), name)
            ),
        )
    )
    return (
        annotated.select("capture_id", "page_url", "hostname", F.col("fetched_at").alias("occurred_at"), F.explode(found).alias("e"))
        .select(
            (F.col("capture_id") * EVENT_ID_STRIDE + F.col("e.seq")).alias("event_id"),
            "capture_id",
            "occurred_at",
            "e.kind",
            "hostname",
            "page_url",
            "e.summary",
            "e.detail",
        )
    )


def new_identifier_events(annotated: DataFrame, indicators: DataFrame, chunk_unit: str = "day") -> DataFrame:
    """``indicator_new`` events: strong identifiers of a changed page that its previous version did not have.

    ``indicators`` holds ``capture_id, ioc_type, value`` for every changed capture.
    """
    versions = previous_row(
        annotated.filter("changed").select("page_url", "hostname", "title", "prev_title", "capture_id", "fetched_at", "is_first"),
        ["page_url"],
        ["fetched_at", "capture_id"],
        time_chunk("fetched_at", chunk_unit),
        ["capture_id"],
        "_before",
    ).withColumn("before_id", F.col("_before.capture_id"))
    strong = indicators.filter(F.col("ioc_type").isin(*STRONG_TYPES)).select("capture_id", "ioc_type", "value").distinct()
    fresh = versions.filter(~F.col("is_first")).join(strong, "capture_id")
    known = indicators.select(F.col("capture_id").alias("before_id"), "ioc_type", "value").distinct()
    return fresh.join(known, ["before_id", "ioc_type", "value"], "left_anti").select(
        "capture_id",
        F.col("fetched_at").alias("occurred_at"),
        F.lit(INDICATOR_NEW).alias("kind"),
        "hostname",
        "page_url",
        F.concat(F.lit("New "), F.col("ioc_type"), F.lit(" on "), F.coalesce("title", "prev_title", "page_url"))
        .substr(1, 512)
        .alias("summary"),
        F.col("value").alias("detail"),
        "ioc_type",
    )


def page_state(annotated: DataFrame) -> DataFrame:
    """Latest state of each page; the last good content survives later failures.

    A partial aggregate, so a hot page is reduced inside every task before the shuffle.
    """
    when = F.struct("fetched_at", "capture_id")
    good = F.when(F.col("ok"), when)
    optional = [c for c in ("content", "title", "body_truncated", "content_sha256", "blocked") if c in annotated.columns]
    last = F.max_by(F.struct("ok", "blocked", "fails", "interval_s", "is_dead", "ever_ok", "fetched_at", "hostname"), when)
    folded = annotated.groupBy("page_url").agg(
        last.alias("l"),
        F.max_by(F.struct(*optional), good).alias("g"),
        F.min("fetched_at").alias("created_at"),
        F.max(F.when(F.col("ok"), F.col("fetched_at"))).alias("content_captured_at"),
        F.max(F.when(F.col("changed"), F.col("fetched_at"))).alias("content_changed_at"),
        F.count(F.lit(1)).alias("attempts"),
    )
    status = (
        F.when(F.col("l.ok") & F.coalesce("l.blocked", F.lit(False)), F.lit("blocked"))
        .when(F.col("l.ok"), F.lit("crawled"))
        .when(F.col("l.is_dead") | ~F.col("l.ever_ok"), F.lit("dead"))
        .otherwise(F.lit("crawled"))
    )
    stored = {c: F.col(f"g.{c}") for c in optional}
    blocked = F.coalesce(stored["blocked"], F.lit(False))
    if "content" in stored:
        stored["content"] = F.when(~blocked, stored["content"])
    stored["blocked"] = blocked
    return folded.select(
        F.col("page_url").alias("url"),
        F.col("l.hostname").alias("hostname"),
        status.alias("status"),
        *[value.alias(c) for c, value in stored.items()],
        F.col("l.fails").alias("consecutive_failures"),
        "attempts",
        "created_at",
        F.col("l.fetched_at").alias("fetched_at"),
        "content_captured_at",
        "content_changed_at",
        F.timestamp_micros(F.unix_micros(F.col("l.fetched_at").cast("timestamp")) + (F.col("l.interval_s") * 1_000_000).cast("bigint")).alias("next_crawl_at"),
    )


def backfill(state: DataFrame, recorded: DataFrame) -> DataFrame:
    """Events that stored page state can prove; nothing already reconstructed is emitted again."""
    name = F.coalesce("title", "url")
    has_hash = F.col("content_sha256").isNotNull()
    base = state.filter(F.col("status").isin("crawled", "dead"))

    def shape(df: DataFrame, kind: Column, summary: Column, at: Column) -> DataFrame:
        return df.select(
            F.col("url").alias("page_url"),
            "hostname",
            kind.alias("kind"),
            summary.substr(1, 512).alias("summary"),
            at.alias("occurred_at"),
            F.lit(BACKFILL_MARK).alias("detail"),
        )

    seen = shape(base.filter(has_hash), F.lit(PAGE_NEW), F.concat(F.lit("First seen: "), name), F.col("created_at"))
    gone = shape(
        base.filter(F.col("status") == "dead"),
        F.when(has_hash, F.lit(PAGE_UNREACHABLE)).otherwise(F.lit(PAGE_DEAD)),
        F.when(has_hash, F.concat(F.lit("Stopped responding: "), name)).otherwise(F.concat(F.lit("Never answered: "), F.col("url"))),
        F.coalesce("fetched_at", "created_at"),
    )
    # One row per (page, kind), so the marker set has the size of the page table and joins by shuffle.
    marked = recorded.filter(F.col("detail") == BACKFILL_MARK).select("page_url", "kind").distinct()
    gone = gone.join(marked.filter(F.col("kind") == PAGE_DEAD).select("page_url"), "page_url", "left_anti")
    return seen.unionByName(gone).join(marked, ["page_url", "kind"], "left_anti")
