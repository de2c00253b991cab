import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import skew
from tidelog.operators import clusters, relations

IND = "page_url STRING, ioc_type STRING, value STRING, context STRING"
REV = "pair_key STRING, left_type STRING, left_value STRING, right_type STRING, right_value STRING, verdict STRING, reason STRING, reviewer STRING, reviewed_at TIMESTAMP"


def greedy(rows, rejected=(), limit=8):
    """Ordered unions on one machine."""
    parent = {}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    pages = {}
    for url, kind, value, _ in rows:
        key = f"{kind}:{value}"
        parent.setdefault(key, key)
        pages.setdefault(url, set()).add((kind, value))
    for url in sorted(pages):
        ids = [f"{k}:{v}" for k, v in sorted(pages[url])]
        if len(ids) > limit:
            continue
        for other in ids[1:]:
            a, b = root(ids[0]), root(other)
            if any(x in parent and y in parent and {root(x), root(y)} == {a, b} for x, y in rejected):
                continue
            parent[max(a, b)] = min(a, b)
    groups = {}
    for n in parent:
        groups.setdefault(root(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def as_sets(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["cluster"], set()).add(f"{r['ioc_type']}:{r['value']}")
    return {frozenset(g) for g in groups.values()}


def random_rows(seed, pages=40, values=40, width=4):
    rng = random.Random(seed)
    return [
        (f"page{p:03d}", rng.choice(["btc", "handle"]), f"v{rng.randrange(values)}", "c")
        for p in range(pages)
        for _ in range(rng.randint(1, width))
    ]


def reviews_of(spark, pairs):
    rows = [(str(i), *x.split(":"), *y.split(":"), "rejected", "", "", None) for i, (x, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, REV)


@pytest.mark.parametrize("seed", [1])
def test_clusters_equal_plain_union_find(spark, seed):
    rows = random_rows(seed)
    assert as_sets(clusters.resolve_clusters(spark.createDataFrame(rows, IND))) == greedy(rows)


@pytest.mark.parametrize(("seed", "cap"), [(3, 200_000), (3, 0), (5, 0)])
def test_rejected_pairs_follow_the_ordered_pass(spark, seed, cap):
    """With ``cap`` zero every touched component is shrunk by distributed rounds first; the result is the same."""
    rows = random_rows(seed, values=25)
    nodes = sorted({f"{k}:{v}" for _, k, v, _ in rows})
    rng = random.Random(seed)
    rejected = [tuple(rng.sample(nodes, 2)) for _ in range(6)]
    got = clusters.resolve_clusters(spark.createDataFrame(rows, IND), reviews_of(spark, rejected), ordered_pass_edges=cap)
    assert as_sets(got) == greedy(rows, rejected)


def test_rejected_ends_of_a_chain(spark):
    rows = [("p1", "btc", "A", ""), ("p1", "btc", "B", ""), ("p2", "btc", "B", ""), ("p2", "btc", "C", "")]
    got = as_sets(clusters.resolve_clusters(spark.createDataFrame(rows, IND), reviews_of(spark, [("btc:A", "btc:C")])))
    assert got == {frozenset({"btc:A", "btc:B"}), frozenset({"btc:C"})}


def test_actors_need_two_identifiers_or_two_pages(spark):
    rows = [("p1", "btc", "ADDR1", ""), ("p2", "btc", "ADDR1", ""), ("p1", "handle", "h1", ""), ("p3", "btc", "ADDR2", ""), ("p1", "email", "v@corp.com", ""), ("p3", "email", "v@corp.com", "")]
    ids = spark.createDataFrame(rows, IND)
    out = clusters.actors(ids, clusters.resolve_clusters(ids)).collect()
    assert [(r["label"], r["identifiers"], r["page_count"]) for r in out] == [("btc:ADDR1", 2, 2)]


def test_long_chain_and_hub(spark):
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(100)] + [("hub", f"leaf{i}") for i in range(500)]
    random.Random(0).shuffle(edges)
    out = clusters.connected_components(spark.createDataFrame(edges, "a STRING, b STRING"))
    counts = {r["root"]: r["n"] for r in out.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"n0000": 101, "hub": 501}


def test_hot_key_lookup_equals_join(spark, monkeypatch):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)], "k STRING, v INT")
    look = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k STRING, w INT")
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    got = sorted(map(tuple, skew.join_lookup(big, "k", look, 600, floor=0).select("k", "v", "w").collect()))
    assert got == sorted(map(tuple, big.join(look, "k").select("k", "v", "w").collect()))


def test_pairs_equal_combinations(spark):
    rows = random_rows(9, width=11)
    got = relations.pair_counts(relations.identifier_pairs(spark.createDataFrame(rows, IND)), max_sources=2).collect()
    pages = {}
    for url, kind, value, _ in rows:
        pages.setdefault(url, set()).add((kind, value))
    want = {}
    for url in sorted(pages):
        if len(pages[url]) <= 8:
            for left, right in itertools.combinations(sorted(pages[url]), 2):
                want.setdefault((*left, *right), []).append(url)
    assert {tuple(r[c] for c in relations._PAIR): (r["source_count"], [s["url"] for s in r["sources"]]) for r in got} == {k: (len(v), v[:2]) for k, v in want.items()}


def test_reviews_without_sources_stay_listed(spark):
    rows = [("p1", "btc", "A", "x"), ("p1", "handle", "B", "y")]
    pairs = relations.pair_counts(relations.identifier_pairs(spark.createDataFrame(rows, IND)))
    key = pairs.first()["key"]
    reviews = spark.createDataFrame([(key, "btc", "A", "handle", "B", "confirmed", "seen", "me", None), ("zz", "btc", "Q", "btc", "R", "rejected", "old", "me", None)], REV)
    out = {r["left_value"]: (r["verdict"], r["source_count"], r["reason"]) for r in relations.reviewed_pairs(pairs, reviews).collect()}
    assert out == {"A": ("confirmed", 1, "seen"), "Q": ("rejected", 0, "old")}


def test_lineage_of_seeds(spark):
    links = [("s", None)] + [(f"c{i}", "s" if i == 0 else f"c{i - 1}") for i in range(20)] + [("o", None), ("o1", "o"), ("x", "y"), ("y", "x"), ("lost", "missing")]
    pages = spark.createDataFrame(links, "url STRING, parent_url STRING")
    seeds = spark.createDataFrame([("s",), ("x",)], "url STRING")
    assert {r["url"] for r in clusters.lineage(pages, seeds).collect()} == {"s", "x", "y", *[f"c{i}" for i in range(20)]}


def test_ego_graph_is_capped(spark):
    rows = [(f"p{i:02d}", "btc", "W", "c") for i in range(35)] + [("p00", "cve", f"CVE-2024-{1000 + i}", "c") for i in range(150)]
    ids = spark.createDataFrame(rows, IND)
    state = spark.createDataFrame([(f"p{i:02d}", i == 1, None) for i in range(35)], "url STRING, blocked BOOLEAN, content_captured_at TIMESTAMP")
    edges = relations.ego_edges(ids, state, "W")
    assert edges.select("url").distinct().count() == 30 and edges.filter("url = 'p00'").count() == 101 and edges.filter("url = 'p01'").count() == 0
    assert relations.ego_limited(ids, state, edges, "W").first()["limited"] is True
    assert relations.ego_nodes(edges).filter("kind = 'source'").count() == 30


def test_pairs_of_one_page_are_not_gathered(spark):
    """Only pairs whose identifiers are both on several pages are counted; the others go on as they are."""
    rows = [(f"p{i}", "btc", f"W{i // 3}", "x") for i in range(9)] + [(f"p{i}", "handle", "H", "y") for i in range(9)] + [(f"p{i}", "jabber", f"j{i}", "z") for i in range(9)]
    pairs = relations.identifier_pairs(spark.createDataFrame(rows, IND))
    assert (pairs.count(), pairs.filter("shared").count()) == (27, 9)
    counted = relations.pair_counts(pairs)
    assert sorted((r["left_value"], r["right_value"], r["source_count"]) for r in counted.filter("source_count > 1").collect()) == [(f"W{i}", "H", 3) for i in range(3)]
    assert counted.count() == 3 + 18


def test_rounds_leave_out_identifiers_of_one_page(spark, monkeypatch):
    rows = [(f"p{p}", "handle", f"h{p // 2}", "") for p in range(8)] + [(f"p{p}", "btc", f"w{p // 4}", "") for p in range(8)] + [(f"p{p}", "eth", f"e{p}-{i}", "") for p in range(8) for i in range(4)]
    rounds, run = [], clusters.connected_components
    monkeypatch.setattr(clusters, "connected_components", lambda edges, *more: (rounds.append(edges.distinct().count()), run(edges, *more))[1])
    assert as_sets(clusters.resolve_clusters(spark.createDataFrame(rows, IND))) == greedy(rows)
    assert rounds == [4]
