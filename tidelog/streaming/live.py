"""Live timeline, live extraction and live alerts over the capture stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import retained
from ..operators import alerts as al
from ..operators import gate as gates
from ..operators import parse, records
from ..operators.indicators import extract_indicators
from ..operators.timeline import page_events

_STATE = "has_ok BOOLEAN, sha STRING, blocked BOOLEAN, title STRING, fails BIGINT, streak BIGINT, last_ok BOOLEAN, last_us BIGINT, last_id BIGINT"
_EXTRA = (
    ", changed BOOLEAN, is_first BOOLEAN, recovered BOOLEAN, went_down BOOLEAN, is_dead BOOLEAN, ever_ok BOOLEAN, fails BIGINT, streak BIGINT, "
    "interval_s DOUBLE, prev_title STRING, late BOOLEAN"
)
_INPUT = "capture_id BIGINT, page_url STRING, hostname STRING, fetched_at TIMESTAMP, ok BOOLEAN, content_sha256 STRING, blocked BOOLEAN, title STRING, error STRING"
_COLUMNS = [part.strip().split(" ")[0] for part in _INPUT.split(",")]


def unique_captures(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each capture id once: replays inside the watermark are dropped."""
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["capture_id"])


def live_annotations(stream: DataFrame, base_s: float = 86_400, max_s: float = 604_800, max_failures: int = 3) -> DataFrame:
    """The columns of ``operators.timeline.annotate`` for a stream, plus ``late``.

    State per page is the last good hash, flags and counters.  A capture older than what its page has already seen
    changes nothing and comes out with ``late`` set, so that a batch run can repair it.  A ``forced`` column works as in the
    batch form.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            has_ok, sha, blocked, title, fails, streak, last_ok, last_us, last_id = state.get
        else:
            has_ok, sha, blocked, title, fails, streak, last_ok, last_us, last_id = False, None, False, None, 0, 0, None, None, None
        rows = pd.concat(list(batches)).sort_values(["fetched_at", "capture_id"], kind="stable")
        out = []
        for row in rows.to_dict("records"):
            forced = row.pop("forced", None)
            ok, now_blocked = bool(row["ok"]), bool(row["blocked"]) if row["blocked"] is not None else False
            at = int(pd.Timestamp(row["fetched_at"]).value // 1000)
            flags = dict(changed=False, is_first=False, recovered=False, went_down=False, is_dead=False, late=False, interval_s=None, prev_title=title)
            if last_us is not None and (at, row["capture_id"]) <= (last_us, last_id):
                out.append({**row, **flags, "late": True, "ever_ok": has_ok, "fails": fails, "streak": streak})
                continue
            if forced is True:  # a re-queued page starts counting failures anew; its outage goes on
                fails = 0
            if ok:
                flags["is_first"] = not has_ok
                flags["changed"] = not has_ok or sha != row["content_sha256"] or blocked != now_blocked
                flags["recovered"] = has_ok and last_ok is False
                streak = 0 if flags["changed"] else streak + 1
                has_ok, sha, blocked, title, fails = True, row["content_sha256"], now_blocked, row["title"], 0
                if base_s > 0 and not now_blocked:
                    flags["interval_s"] = float(base_s) if streak == 0 else float(min(base_s * 2.0 ** min(streak, 62), max_s))
            else:
                fails += 1
                flags["went_down"] = has_ok and bool(last_ok)
                flags["is_dead"] = base_s <= 0 or fails >= max_failures
                if base_s > 0 and not flags["is_dead"]:
                    flags["interval_s"] = float(min(base_s * fails, max_s))
            last_ok, last_us, last_id = ok, at, int(row["capture_id"])
            out.append({**row, **flags, "ever_ok": has_ok, "fails": fails, "streak": streak})
        state.update((has_ok, sha, blocked, title, fails, streak, last_ok, last_us, last_id))
        yield pd.DataFrame(out)[[*_COLUMNS, "changed", "is_first", "recovered", "went_down", "is_dead", "ever_ok", "fails", "streak", "interval_s", "prev_title", "late"]]

    return (
        stream.select(*_COLUMNS, *(["forced"] if "forced" in stream.columns else []))
        .groupBy("page_url")
        .applyInPandasWithState(step, _INPUT + _EXTRA, _STATE, "append", GroupStateTimeout.NoTimeout)
    )


def live_timeline(stream: DataFrame, **settings) -> DataFrame:
    """Timeline events of a capture stream; equal to the batch events when nothing arrives late."""
    return page_events(live_annotations(stream, **settings).filter(~F.col("late")))


def live_extraction(stream: DataFrame, rules: DataFrame, known_bad: DataFrame) -> dict[str, DataFrame]:
    """Gate, parse and extract a stream of raw pages (``url, html, content_type, content_sha256``).

    All steps are stateless.  Text that the gate refuses is gone before any extractor sees it.
    """
    parsed = parse.parse_pages(stream)
    pages = gates.storable(gates.gate(parsed, rules, known_bad)).filter(F.col("text").isNotNull())
    return {
        "pages": pages,
        "indicators": extract_indicators(pages, url="url"),
        "credentials": records.extract_credentials(pages, url="url"),
        "listings": records.extract_listings(pages, url="url", blocks="blocks"),
    }


def alert_sink(
    alerts_path: str, watchlists: DataFrame, event_columns: tuple[str, ...], versions: Callable[[], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the event alerts of each micro-batch.

    Alerts already stored are left out by key, so a replayed batch adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "watchlist_id BIGINT, page_url STRING, matched_value STRING, dedup_key STRING, event_id BIGINT"
        path = spark._jvm.org.apache.hadoop.fs.Path(alerts_path)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        prior = spark.read.schema(schema).parquet(alerts_path) if there else spark.createDataFrame([], schema)
        fresh = al.event_alerts(watchlists, batch.select(*event_columns), versions(), prior)
        fresh.select("watchlist_id", "page_url", "matched_value", "dedup_key", "event_id").write.mode("append").parquet(alerts_path)

    return write


def content_alert_sink(alerts_path: str, watchlists: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for content lists over micro-batches of stored pages with their text."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "watchlist_id BIGINT, page_url STRING, matched_value STRING, dedup_key STRING, event_id BIGINT, body STRING"
        path = spark._jvm.org.apache.hadoop.fs.Path(alerts_path)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        prior = spark.read.schema(schema).parquet(alerts_path) if there else spark.createDataFrame([], schema)
        pages = batch.filter(retained())
        matches = al.content_matches(
            watchlists, pages, extract_indicators(pages, url="url", text="content"), records.extract_credentials(pages, url="url", text="content")
        )
        fresh = al.content_alerts(watchlists, matches, pages, prior)
        bodies = pages.select(F.col("url").alias("page_url"), F.when(F.coalesce(~F.col("body_truncated"), F.lit(False)), F.col("content_sha256")).alias("body"))
        kept = fresh.join(bodies, "page_url", "left")
        # A body alerted in an earlier batch stays alerted, although its page is not in this batch.
        seen = prior.filter(F.col("body").isNotNull()).select("watchlist_id", "body").distinct()
        kept.join(seen, ["watchlist_id", "body"], "left_anti").select(
            "watchlist_id", "page_url", "matched_value", "dedup_key", "event_id", "body"
        ).write.mode("append").parquet(alerts_path)

    return write
