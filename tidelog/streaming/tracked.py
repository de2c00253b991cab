"""The live timeline with identifiers: one stateful pass over captures, and the repair of what came too late for it.

A page's state is one value: its last good version, the identifiers of that version, and its counters, so that a micro-batch reads and
writes the state of a page once.  The captures of a page in one micro-batch are worked on together as arrays.  A capture that is not newer than what its page has seen changes no state
and goes aside as late, replays included; ``repair_late`` works those into the stored log.  No watermark is involved, so nothing
is dropped for its age and the state is one entry a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import timeline as tl
from ..schemas import INDICATOR_NEW

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDENTIFIERS = "ARRAY<STRUCT<ioc_type: STRING, value: STRING>>"
# The time travels as microseconds.
_INPUT = "capture_id BIGINT, page_url STRING, hostname STRING, fetched_at BIGINT, ok BOOLEAN, content_sha256 STRING, blocked BOOLEAN, title STRING, error STRING, forced BOOLEAN"
_COLUMNS = [part.split()[0] for part in _INPUT.split(", ")]
_NOTES = "changed BOOLEAN, is_first BOOLEAN, recovered BOOLEAN, went_down BOOLEAN, is_dead BOOLEAN, ever_ok BOOLEAN, fails BIGINT, streak BIGINT, interval_s DOUBLE, prev_title STRING"
_OUT = Row(*_COLUMNS, *tl.NOTES, "late", "added")
_PAGE = "has_ok BOOLEAN, sha STRING, blocked BOOLEAN, title STRING, fails BIGINT, streak BIGINT, last_ok BOOLEAN, last_us BIGINT, last_id BIGINT, held_types ARRAY<STRING>, held_values ARRAY<STRING>"
_NEW = (False, None, False, None, 0, 0, None, None, None, (), ())


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _last_before(mark: np.ndarray) -> np.ndarray:
    """For every place the last marked place before it, or -1."""
    upto = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    return np.concatenate(([-1], upto[:-1]))


def flags(ok: np.ndarray, forced: np.ndarray, sha: np.ndarray, blocked: np.ndarray, titles: np.ndarray, state: tuple, base_s: float, max_s: float, max_failures: int) -> tuple[dict, tuple]:
    """Notes on the captures of one page, in order, and the page's state after them."""
    has_ok, last_sha, last_blocked, last_title, fails, streak, last_obs, *_ = state
    at = np.arange(len(ok))
    good = _last_before(ok)
    inner = good >= 0
    had = inner | has_ok
    prev_sha = np.where(inner, sha[good], last_sha)
    prev_blocked = np.where(inner, blocked[good], last_blocked)
    prev_title = np.where(inner, titles[good], last_title)
    prev_obs = np.concatenate(([bool(last_obs) if last_obs is not None else True], ok[:-1]))
    same = np.array([a == b for a, b in zip(sha, prev_sha, strict=True)], dtype=bool) & (blocked == prev_blocked)
    changed = ok & (~had | ~same)
    # A count since its last reset: the running sum less what it was there.
    failed = np.cumsum(~ok)
    reset = np.maximum.accumulate(np.where(ok | forced, at, -1))
    base = np.where(reset >= 0, failed[reset] - (~ok[reset] & forced[reset]), -fails)
    n_fails = failed - base
    steady = np.cumsum(ok & ~changed)
    turn = np.maximum.accumulate(np.where(changed, at, -1))
    n_streak = steady - np.where(turn >= 0, steady[turn], -streak)
    dead = ~ok & ((base_s <= 0) | (n_fails >= max_failures))
    interval = np.full(len(ok), np.nan)
    if base_s > 0:
        due = ok & ~blocked
        interval[due] = np.where(n_streak[due] == 0, float(base_s), np.minimum(base_s * 2.0 ** np.minimum(n_streak[due], 62), max_s))
        again = ~ok & ~dead
        interval[again] = np.minimum(base_s * n_fails[again].astype(float), max_s)
    notes = {
        "changed": changed, "is_first": ok & ~had, "recovered": ok & had & ~prev_obs, "went_down": ~ok & had & prev_obs, "is_dead": dead, "ever_ok": ok | had,
        "fails": n_fails, "streak": n_streak, "interval_s": interval, "prev_title": prev_title,
    }
    last = int(np.flatnonzero(ok)[-1]) if ok.any() else -1
    kept = (True, sha[last], bool(blocked[last]), titles[last]) if last >= 0 else (has_ok, last_sha, last_blocked, last_title)
    return notes, (*kept, int(n_fails[-1]), int(n_streak[-1]), bool(ok[-1]))


def _known(values: np.ndarray) -> np.ndarray:
    """Booleans in which what is missing is false."""
    return values if values.dtype == bool else np.array([v is not None and v == v and bool(v) for v in values], dtype=bool)


def _held(values: np.ndarray) -> np.ndarray:
    """Objects in which what is missing is None."""
    return np.array([None if v is None or v != v else v for v in values], dtype=object)


def _objects(values: tuple) -> np.ndarray:
    return np.fromiter(values, dtype=object, count=len(values))


def _identifiers(identifiers: np.ndarray, turns: np.ndarray, before: set, first: bool, added: list) -> list[tuple[str, str]]:
    """Put into ``added`` what every new version has that the version before it had not; the identifiers of the last one."""
    for place in turns.tolist():
        found = identifiers[place]
        now = set() if found is None else {(i["ioc_type"], i["value"]) for i in found if i["ioc_type"] is not None and i["value"] is not None}
        if not (first and place == turns[0]):
            added[place] = [{"ioc_type": t, "value": v} for t, v in sorted(now - before)]
        before = now
    return sorted(before)


class PageTracker(StatefulProcessor):
    """State of one page: its last good version with its identifiers, and its counters."""

    def __init__(self, base_s: float, max_s: float, max_failures: int):
        self.settings = (base_s, max_s, max_failures)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", _PAGE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The rows of a page in one micro-batch are few, so they are worked on as arrays; a frame for each page would cost more than all else.
        names = (*_COLUMNS, "identifiers")
        batch = {name: _objects(values) for name, values in zip(names, zip(*[[row[name] for name in names] for row in rows], strict=True), strict=True)}
        us = np.array([np.iinfo("int64").min if at is None else at for at in batch["fetched_at"]], dtype="int64")
        order = np.lexsort((batch["capture_id"].astype("int64"), us))
        batch, us = {name: values[order] for name, values in batch.items()}, us[order]
        ids = batch["capture_id"].astype("int64")
        # Every call crosses to the JVM; without a value ``get`` returns None.
        known = self.page.get()
        state = _NEW if known is None else tuple(known)
        late = np.ones(len(ids), dtype=bool)
        late[np.unique(ids, return_index=True)[1]] = False
        if state[7] is not None:
            late |= (us < state[7]) | ((us == state[7]) & (ids <= state[8]))
        fresh = np.flatnonzero(~late)
        out = {name: batch[name] for name in _COLUMNS}
        added: list = [[] for _ in range(len(ids))]
        columns = {name: np.full(len(ids), None, dtype=object) for name in tl.NOTES}
        if len(fresh):
            notes, kept = flags(*(_known(batch[n])[fresh] for n in ("ok", "forced")), _held(batch["content_sha256"])[fresh], _known(batch["blocked"])[fresh], _held(batch["title"])[fresh], state, *self.settings)
            for name, values in notes.items():
                columns[name][fresh] = values
            held = _identifiers(batch["identifiers"], fresh[notes["changed"]], set(zip(state[9], state[10], strict=True)), bool(notes["is_first"].any()), added)
            self.page.update((*kept, int(us[fresh[-1]]), int(ids[fresh[-1]]), [t for t, _ in held], [v for _, v in held]))
        for values in zip(*[out[name] for name in _COLUMNS], *[columns[name] for name in tl.NOTES], late.tolist(), added, strict=True):
            yield _OUT(*[None if v != v else v for v in values])

    def close(self) -> None:
        pass


def tracked_captures(stream: DataFrame, base_s: float = 86_400, max_s: float = 604_800, max_failures: int = 3) -> DataFrame:
    """The captures with the notes of ``timeline.annotate``, ``late``, and ``added``: the identifiers that a new version brought.

    ``stream`` has the columns of captures and ``identifiers``, the linking identifiers of each body; ``forced`` is optional.
    """
    forced = F.col("forced") if "forced" in stream.columns else F.lit(False)
    rows = stream.withColumns({"forced": forced, "fetched_at": F.unix_micros(F.col("fetched_at").cast("timestamp"))}).select(*_COLUMNS, F.col("identifiers").cast(IDENTIFIERS).alias("identifiers"))
    notes = rows.groupBy("page_url").transformWithState(
        statefulProcessor=PageTracker(base_s, max_s, max_failures), outputStructType=f"{_INPUT}, {_NOTES}, late BOOLEAN, added {IDENTIFIERS}", outputMode="Append", timeMode="None"
    )
    return notes.withColumn("fetched_at", F.timestamp_micros("fetched_at"))


def tracked_events(tracked: DataFrame) -> DataFrame:
    """All timeline events of tracked captures, ``indicator_new`` among them."""
    on_time = tracked.filter(~F.col("late"))
    new = on_time.select("capture_id", F.col("fetched_at").alias("occurred_at"), "hostname", "page_url", F.coalesce("title", "prev_title", "page_url").alias("_name"), F.posexplode("added").alias("_at", "_i"))
    new = new.select(
        (F.col("capture_id") * tl.EVENT_ID_STRIDE + 10 + F.col("_at")).alias("event_id"), "capture_id", "occurred_at", F.lit(INDICATOR_NEW).alias("kind"), "hostname", "page_url",
        F.concat(F.lit("New "), F.col("_i.ioc_type"), F.lit(" on "), F.col("_name")).substr(1, 512).alias("summary"), F.col("_i.value").alias("detail"),
    )
    return tl.page_events(on_time).unionByName(new)


def repair_late(log: DataFrame, base_s: float = 86_400, max_s: float = 604_800, max_failures: int = 3) -> DataFrame:
    """A stored log of tracked captures with its late rows worked in, as if all had come in time."""
    columns = [*_COLUMNS, *tl.NOTES]
    on_time, late = log.filter(~F.col("late")).select(*columns), log.filter("late").select(*_COLUMNS)
    summaries = tl.chunk_summaries(on_time.select(*_COLUMNS))
    changed, chunks, _ = tl.repair(on_time, summaries, late, base_s, max_s, max_failures)
    return tl.repaired(on_time, changed, chunks)
