import json

from tidelog.llm.tool_calls import link_tool_calls

TOOLS = {"add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "list": {"items": ("array", True)}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, content string"


def run(spark, calls, results):
    return link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()


def test_links_orders_and_checks(spark):
    calls = [
        (1, "x", 0, "add", '{"b": 2, "a": 1.5}', ["z"]),
        (1, "y", 1, "add", '{"a": "1", "c": 0}', []),
        (1, "z", 2, "list", '{"items": [ {"q":1, "b":"\\u00e9\\n"} ]}', ["y", "nowhere"]),
        (2, "x", 0, "nothing", "{}", None),
        (2, "w", 1, "add", "[1]", ["x"]),
        (3, "p", 0, "add", '{"a":1,"b":2}', ["q"]),
        (3, "q", 1, "add", '{"a":1,"b":2}', ["p"]),
        (3, "r", 2, "add", '{"a":1,"b":2}', []),
    ]
    rows = run(spark, calls, [(1, "x", "three"), (2, "x", "a"), (2, "x", "b"), (9, "lost", "?")])
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert [by[1, c].place for c in "yzx"] == [0, 1, 2] and [by[1, c].level for c in "yzx"] == [0, 1, 2]
    assert by[1, "x"].errors == [] and by[1, "y"].errors == ["missing b", "type a", "unexpected c"] and by[1, "z"].errors == []
    assert by[1, "x"].message == '{"arguments":{"a":1.5,"b":2},"call_id":"x","errors":[],"name":"add","result":"three"}'
    assert '"arguments":{"items":[{"b":"é\\n","q":1}]}' in by[1, "z"].message
    assert by[2, "x"].errors == ["unknown tool"] and by[2, "w"].errors == ["malformed arguments"] and by[2, "x"].level is None
    assert sorted(json.loads(r.message)["result"] for r in rows if (r.conv_id, r.call_id) == (2, "x")) == ["a", "b"]
    assert by[3, "r"].place == 0 and by[3, "p"].level == by[3, "q"].level == -1 and by[3, "p"].errors == ["cyclic"]
    assert by[9, "lost"].place is None and by[9, "lost"].errors == ["result without call"]


def test_nulls_repeats_and_empty(spark):
    calls = [(1, "x", 0, "add", '{"a":1,"b":2}', None), (1, "x", 1, "add", '{"a":1,"b":2}', ["x"]), (1, None, 2, "add", None, None), (None, "x", 0, None, None, None)]
    rows = run(spark, calls, [(1, "x", None), (1, None, "n"), (None, "x", "m")])
    assert sorted(str(r.errors) for r in rows if r.place is not None) == sorted(map(str, [[], ["repeated id"], ["call without id"], ["malformed arguments"]]))
    assert sum(r.errors == ["result without call"] for r in rows) == 2
    assert run(spark, [], []) == []


def test_long_conversation_in_blocks(spark):
    calls = [(7, f"c{i}", i, "add", '{"a":1,"b":2}', [f"c{i - 1}"]) for i in range(1500)]
    rows = run(spark, calls, [])
    assert sorted((r.place, r.call_id) for r in rows) == sorted((i, f"c{i}") for i in range(1500))


def test_inverted_chains_and_several_needs(spark):
    calls = [(5, f"c{i:03d}", i, "add", '{"a":1,"b":2}', [f"c{i + 1:03d}"]) for i in range(100)]
    calls += [(5, "c100", 100, "add", '{"a":1,"b":2}', ["m"]), (5, "m", 101, "add", '{"a":1,"b":2}', ["z1", "z9"]), (5, "z1", 102, "add", "{}", ["z2"]), (5, "z2", 103, "add", "{}", None), (5, "z9", 104, "add", "{}", None)]
    calls += [(6, "a", 0, "add", "{}", ["b"]), (6, "b", 1, "add", "{}", ["c"]), (6, "c", 2, "add", "{}", ["b"]), (6, "d", 3, "add", "{}", ["a", "e"]), (6, "e", 4, "add", "{}", [])]
    level = {(r.conv_id, r.call_id): r.level for r in run(spark, calls, [])}
    assert level[5, "z2"] == level[5, "z9"] == 0 and level[5, "z1"] == 1 and level[5, "m"] == 2 and level[5, "c100"] == 3
    assert all(level[5, f"c{i:03d}"] == 103 - i for i in range(100))
    assert level[6, "e"] == 0 and all(level[6, c] == -1 for c in "abcd")
