import random

import numpy as np

from tidelog.llm import ngram_join
from tidelog.llm.ngram_join import _folds, _nodes, jaccard_components


def brute(rows, shingle_set, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += passage
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_same_components_as_comparing_all_pairs(spark, shingle_set):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows, shingle_set)


def test_nulls_short_texts_ties_and_repeated_rows(spark, shingle_set):
    long_text = " ".join(f"x{i}" for i in range(3000))
    rows = [(7, "a b c"), (3, "A\tb  C"), (9, None), (8, ""), (5, " \n"), (2, "a b"), (None, "a b c"), (7, "a b c"), (11, long_text), (10, long_text + " tail"), (12, "é É")]
    assert run(spark, rows) == brute(rows, shingle_set)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, node long, token string")
    assert {r.component_id for r in jaccard_components(df).collect()} == {1}


def test_large_buckets_and_frequent_tokens(spark, shingle_set, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows, shingle_set)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 40)
    assert run(spark, rows) == brute(rows, shingle_set)


def test_links_found_by_the_token_orders_alone(spark, shingle_set, monkeypatch):
    """Without star edges every link comes from prefix tokens."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 0)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows, shingle_set)


def test_sets_that_share_one_fold_stay_apart():
    tokens, offsets = np.arange(1, 13, dtype=np.uint64), np.array([0, 4, 8, 8, 12])
    nodes, checks = _folds(tokens, offsets)
    assert len(set(nodes.tolist())) == 4 and nodes[2] == checks[2] == 0
    apart = _nodes(tokens, offsets, np.sort(nodes[[1]])).view(np.uint64)
    assert apart[1] != nodes[1] and (apart[[0, 2, 3]] == nodes[[0, 2, 3]]).all()
