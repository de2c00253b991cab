import random

from tidelog.llm import decontaminate
from tidelog.llm.decontaminate import contained_items, hashes_needed


def brute(docs, items, shingle_set):
    out = []
    for d, text in docs:
        for i, item in items:
            own, need = shingle_set(text), shingle_set(item)
            k = len(own & need)
            if need and 100 * k >= 75 * len(need):
                out.append((d, i, len(need), k))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 90)))) for i in range(40)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.choice([2, 10, 200, 3000]))]
        for _, item in rng.sample(items, rng.choice([0, 0, 1, 2, 25])):
            part = item.split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(200, items[0][1].upper()), (201, None), (202, ""), (None, "x " + items[5][1]), (0, docs[0][1]), (203, " ".join(t for _, t in items))]
    return docs, items + [(90, None), (91, " "), (92, items[3][1])]


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contained_items(d, i).collect()), key=str)


def test_equals_comparing_every_pair(spark, shingle_set):
    docs, items = tables(1)
    assert run(spark, docs, items) == brute(docs, items, shingle_set)


def test_blocks_of_items(spark, shingle_set, monkeypatch):
    docs, items = tables(2)
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 400)
    assert run(spark, docs[:40], items) == brute(docs[:40], items, shingle_set)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == [] and run(spark, [(1, "a b c d e f")], []) == []


def test_more_hashes_for_larger_documents():
    counts = [hashes_needed(k, 5, 75) for k in range(4, 12)]
    found = [c for c in counts if c]
    assert found == sorted(found) and counts[-1] == 0
