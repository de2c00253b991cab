import hashlib
import random
from collections import Counter

import numpy as np

from tidelog.llm import suffix_dedup
from tidelog.llm.suffix_dedup import Suffixes, remove_repeats


def brute(rows, span):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for (key, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, 3), p[a : rng.randint(a, len(p))])
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3][:-1] + "x", "a" * 450, "ab" * 300, None, "", "short", passages[0] + passages[0]]
    return [(i, t) for i, t in enumerate(texts)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)


def test_equals_counting_all_strings(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows, 200)


def test_split_classes_and_pieces(spark, monkeypatch):
    rows = corpus(2, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix_dedup, "RUN", 2)
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(rows, 200)


def test_repeated_rows_null_ids_and_empty_table(spark):
    long_text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(900))
    rows = [(1, long_text), (1, long_text), (None, "y" * 50), (None, long_text[100:350]), (4, None)]
    assert run(spark, rows) == brute(rows, 200)
    assert run(spark, []) == []


def test_pieces_of_a_long_text_cover_every_start(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = set()
    for part, cuts, _, places in suffix_dedup._pieces(pa.array([data.tobytes()], pa.binary()), 200):
        gram, context, piece, anchor, lo, hi = suffix_dedup._contexts(part, cuts, 200)
        whole |= {(s + places[0], int(a) + places[0]) for a, x, y in zip(anchor, lo, hi, strict=True) for s in range(x, y + 1)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = set()
    for part, cuts, _, places in suffix_dedup._pieces(pa.array([data.tobytes()], pa.binary()), 200):
        gram, context, piece, anchor, lo, hi = suffix_dedup._contexts(part, cuts, 200)
        parts |= {(s + places[0], int(a) + places[0]) for a, x, y in zip(anchor, lo, hi, strict=True) for s in range(x, y + 1)}
    assert whole == parts and len(whole) == 4801


def test_sort_equals_python_sort():
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(600)).encode()
    starts = np.array(sorted(rng.sample(range(600), 200)))
    ends = np.minimum(starts + 60, 600)
    group = np.array([rng.randrange(3) for _ in starts])
    order = Suffixes(np.frombuffer(text, dtype=np.uint8), starts, ends, group).sort()
    want = sorted(range(len(starts)), key=lambda i: (group[i], text[starts[i] : ends[i]]))
    assert [(group[i], text[starts[i] : ends[i]]) for i in order] == [(group[i], text[starts[i] : ends[i]]) for i in want]
