import random
import zlib
from collections import Counter

from tidelog.llm import sharding
from tidelog.llm.sharding import shard_by_bytes


def check(rows, got, shards, tolerance):
    want = Counter((key, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for key, text in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    total = sum(r["size"] for r in got)
    for shard in range(shards):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= tolerance


def test_shards_are_near_equal_and_keep_texts_together(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300)))) for i in range(3000)]
    rows += [(5000 + i, rows[i % 40][1]) for i in range(200)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4).collect()
    check(rows, got, 4, 3500)
    homes = {}
    texts = dict(rows)
    for r in got:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_hot_text_is_divided(spark):
    rows = [(i, "the same text") for i in range(4000)] + [(9000 + i, f"text {i}") for i in range(2000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(rows, got, 8, 400)
    assert len({r.shard for r in got if r.doc_id < 4000}) > 4


def test_groups_stay_whole_while_a_shard_has_room(spark):
    rng = random.Random(4)
    rows = [(i, "x" * 70) for i in range(400)] + [(1000 + i, "y" * 50) for i in range(300)] + [(2000 + i, f"{rng.random()} filler {i}") for i in range(4000)]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, key string, part int").repartition(4)
    got = shard_by_bytes(df, shards=4).collect()
    check(rows, got, 4, 2500)
    assert len({r.shard for r in got if r.doc_id < 400}) == 1 and len({r.shard for r in got if 1000 <= r.doc_id < 1300}) == 1


def test_the_splitters_place_the_records():
    sample = [(i, 1.0) for i in range(1000)]
    cuts, shard_of = sharding._boundaries(sample, [100.0, 0.0, 300.0], 8)
    begins = [c for c, a, b in zip(cuts, shard_of[:-1], shard_of[1:]) if b > a]
    assert begins == [250] and shard_of[0] == 0 and shard_of[-1] == 2
    assert sharding._boundaries([], [1.0, 2.0], 4) == ([], [1])
    dealt, loads = sharding._deal([(90, 1), (90, 2), (200, 3)], {3: [(i, 2) for i in range(100)]}, 4, 400)
    assert dealt[1, -1] != dealt[2, -1] and {p for k, p in dealt if k == 3} == set(range(100)) and max(loads) <= 104


def test_nulls_repeats_few_rows_and_empty(spark):
    rows = [(None, None), (None, "a"), (3, ""), (3, ""), (4, "x" * 5000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(0 <= r.shard < 16 for r in got)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_binary_search_over_splitters(spark):
    cuts = [(-5, 0), (3, 2), (3, 9), (70, 0)]
    rows = [(k, p) for k in (-9, -5, 0, 3, 69, 70, 99) for p in (0, 2, 5, 9)]
    got = sharding._range_of(spark.createDataFrame(rows, "key long, part int"), cuts).collect()
    assert all(r["range"] == sum(c <= (r.key, r.part) for c in cuts) for r in got)
