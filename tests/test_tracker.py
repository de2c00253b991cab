from pyspark.sql import Row

from tidelog.streaming.tracked import PageTracker


class OneValue:
    """A state store with a single value, counting what crosses to it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def capture(n, sha, *values):
    return Row(capture_id=n, page_url="u", hostname="h", fetched_at=n * 1000, ok=sha is not None, content_sha256=sha, blocked=False, title=None, error=None, forced=None, identifiers=[Row(ioc_type="btc", value=v) for v in values])


def test_the_state_of_a_page_is_read_and_written_once_a_batch():
    store, tracker = OneValue(), PageTracker(100, 1000, 3)
    tracker.init(store)
    first = list(tracker.handleInputRows(("u",), iter([capture(2, "b", "y", "z"), capture(1, "a", "x", "y")]), None))
    assert [(r.capture_id, r.is_first, r.changed, [i["value"] for i in r.added]) for r in first] == [(1, True, True, []), (2, False, True, ["z"])]
    then = list(tracker.handleInputRows(("u",), iter([capture(1, "a"), capture(3, None), capture(4, "c", "z", "w")]), None))
    assert [(r.capture_id, r.late, r.changed, [i["value"] for i in r.added]) for r in then] == [(1, True, None, []), (3, False, False, []), (4, False, True, ["w"])]
    assert [r.interval_s for r in then] == [None, 100.0, 100.0] and store.calls == ["get", "update"] * 2
    assert store.value[-2:] == (["btc", "btc"], ["w", "z"])
