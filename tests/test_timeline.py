import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import timeline as tl
from tidelog.operators import views

SCHEMA = "capture_id BIGINT, page_url STRING, hostname STRING, fetched_at TIMESTAMP, ok BOOLEAN, content_sha256 STRING, blocked BOOLEAN, title STRING, error STRING, forced BOOLEAN"


def log(spark, sequences, hours_apart=7):
    """``x`` is a failure, ``!`` a failure requested by a re-queue, other letters are body hashes (upper case: blocked)."""
    import datetime as dt

    rows, n = [], 0
    for url, seq in sequences.items():
        for i, ch in enumerate(seq):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours_apart * i)
            ok = ch not in "x!"
            rows.append((n, url, url, at, ok, ch.lower() if ok else None, ok and ch.isupper(), "T" if ok else None, None if ok else "timeout", ch == "!"))
            n += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def kinds(events):
    return [r["kind"] for r in events.orderBy("occurred_at", "event_id").collect()]


def by_hand(seq, base, top, limit):
    """Plain walk over one page's captures."""
    sha = blocked = last = None
    fails, interval, out = 0, None, []
    for ch in seq:
        if ch in "x!":
            if ch == "!":
                fails = 0
            fails += 1
            down = sha is not None and last is True
            dead = base <= 0 or fails >= limit
            out.append((False, False, False, down, dead, fails, None if dead else float(min(base * fails, top))))
            last = False
        else:
            h, b = ch.lower(), ch.isupper()
            first = sha is None
            changed = first or h != sha or b != blocked
            out.append((changed, first, not first and last is False, False, False, 0, None))
            if base > 0 and not b:
                interval = float(base) if changed or interval is None else float(min(interval * 2, top))
                out[-1] = out[-1][:6] + (interval,)
            sha, blocked, fails, last = h, b, 0, True
    return out


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_annotations_equal_a_plain_walk(spark, unit):
    rng = random.Random(7)
    sequences = {f"p{i}": "".join(rng.choice("aaabBx!x") for _ in range(rng.randint(1, 25))) for i in range(60)}
    base, top, limit = 100, 1000, 3
    got = tl.annotate(log(spark, sequences), base, top, limit, chunk_unit=unit)
    rows = got.orderBy("page_url", "capture_id").collect()
    found = {}
    for r in rows:
        found.setdefault(r["page_url"], []).append(
            (r["changed"], r["is_first"], r["recovered"], r["went_down"], r["is_dead"], r["fails"], r["interval_s"])
        )
    for url, seq in sequences.items():
        assert found[url] == by_hand(seq, base, top, limit), (url, seq)


@pytest.mark.parametrize(
    ("seq", "limit", "expected"),
    [
        ("aabxxc", 9, ["page_new", "page_changed", "page_unreachable", "page_recovered", "page_changed"]),
        ("axx", 2, ["page_new", "page_unreachable", "page_dead"]),
        ("ax!!x", 9, ["page_new", "page_unreachable"]),
        ("xxa", 2, ["page_dead", "page_new"]),
    ],
)
def test_event_sequences(spark, seq, limit, expected):
    assert kinds(tl.page_events(tl.annotate(log(spark, {"p": seq}), max_failures=limit))) == expected


def test_intervals_adapt(spark):
    rows = tl.annotate(log(spark, {"p": "aab"}), 100, 1000, 3).orderBy("capture_id").collect()
    assert [r["interval_s"] for r in rows] == [100.0, 200.0, 100.0]


def test_failing_page_is_down_but_still_crawled(spark):
    a = tl.annotate(log(spark, {"p": "ax"}))
    state = tl.page_state(a)
    assert state.first()["status"] == "crawled"
    live = views.host_liveness(state, tl.page_events(a)).first()
    assert live["state"] == "down" and live["offline_since"] is not None


def test_liveness_order(spark):
    a = tl.annotate(log(spark, {"gone": "axxx", "never": "xxx", "live": "a"}), max_failures=3)
    ranked = views.rank_liveness(views.host_liveness(tl.page_state(a), tl.page_events(a)))
    assert [r["state"] for r in ranked.collect()] == ["down", "up", "never"]


def test_backfill_is_idempotent(spark):
    a = tl.annotate(log(spark, {"gone": "axxx", "never": "xxx", "live": "a"}), max_failures=3)
    state = tl.page_state(a)
    none = spark.createDataFrame([], "page_url STRING, kind STRING, detail STRING")
    first = tl.backfill(state, none)
    counts = {r["kind"]: r["n"] for r in first.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"page_new": 2, "page_unreachable": 1, "page_dead": 1}
    assert tl.backfill(state, first.select("page_url", "kind", "detail")).count() == 0


def test_new_identifier_only_after_the_first_version(spark):
    a = tl.annotate(log(spark, {"p": "aab"}))
    ids = spark.createDataFrame(
        [(0, "pgp_fp", "K1"), (2, "pgp_fp", "K1"), (2, "pgp_fp", "K2"), (2, "email", "v@corp.com")], "capture_id BIGINT, ioc_type STRING, value STRING"
    )
    rows = tl.new_identifier_events(a, ids).collect()
    assert [(r["ioc_type"], r["detail"]) for r in rows] == [("pgp_fp", "K2")]


def test_quality_trio(spark):
    body = "a useful long body of text " * 5
    rows = [("u1", body, "h", False, False), ("u2", body, "h", False, False), ("u3", body, "h2", True, False)]
    pages = spark.createDataFrame(rows, "url STRING, content STRING, content_sha256 STRING, body_truncated BOOLEAN, blocked BOOLEAN")
    q = views.collection_quality(pages.withColumn("content_captured_at", F.lit("2024-01-01").cast("timestamp")), "2024-01-02").first()
    assert (q["retained_pages"], q["complete_captures"], q["duplicate_rate"], q["unique_substantive_pages"]) == (3, 2, 0.5, 1)
    groups = views.duplicate_groups(pages.withColumn("hostname", F.lit("h"))).collect()
    assert [(g["copies"], len(g["sources"])) for g in groups] == [(2, 2)]
