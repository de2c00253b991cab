import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import fill_middle
from tidelog.llm.fill_middle import ChunkCache, Cutter, fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_text(rng, size):
    signs = "abcdef    \n\t\r\x0b\x0c\x85 \x1c<>PSMéß日🙂"
    return "".join(rng.choice(signs) for _ in range(size))


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, " a "), (6, "<P>"), (7, "x <M> y"), (8, "<P <S <M P> S> M>"), (9, "日" * 30_000), (10, "a" * 50_000), (11, " " * 50_000), (12, "a b " * 20_000)]


@pytest.fixture
def rows():
    rng = random.Random(4)
    found = ODD + [(100 + i, some_text(rng, rng.randrange(0, 60))) for i in range(300)]
    shared = some_text(rng, 9000)
    found += [(500 + i, some_text(rng, rng.randrange(0, 40)) + shared + some_text(rng, rng.randrange(0, 3000))) for i in range(40)]
    return found + [(600, shared), (600, shared), (None, shared), (601, "<" + shared + "<S"), *[(700 + i, t) for i, (_, t) in enumerate(ODD)]]


def test_equals_the_pattern_and_restores_the_text(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    out = fill_in_middle(df)
    got = out.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(i, t) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.back) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert fill_in_middle(df.limit(0)).count() == 0
    assert fill_in_middle(df, keep=("lang",)).columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("bits, longest", [(0, 7), (2, 64), (5, 40), (30, 16)])
def test_every_cut_with_small_chunks(monkeypatch, bits, longest):
    monkeypatch.setattr(fill_middle, "BORDER_BITS", bits)
    monkeypatch.setattr(fill_middle, "LONGEST_CHUNK", longest)
    rng = random.Random(bits)
    texts = [some_text(rng, rng.randrange(0, 300)) for _ in range(30)]
    texts += [texts[3], "", texts[3], " " * 70, "é" * 70]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    cutter = Cutter(data, np.cumsum([0] + [len(t.encode()) for t in texts]), ChunkCache())
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        assert cutter.tokens[i] == len(tokens)
        for k in range(len(tokens) + 1):
            head = "".join(tokens[:k])
            assert cutter.cut(i, k) == (len(head.encode()), len(head))


def test_shared_chunks_are_summarised_once_and_equal_hashes_are_not_trusted():
    rng = random.Random(9)
    passage = some_text(rng, 40_000)
    texts = [some_text(rng, 700) + passage for _ in range(6)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    cache = ChunkCache()
    cutter = Cutter(data, np.cumsum([0] + [len(t.encode()) for t in texts]), cache)
    assert cache.held < 0.4 * len(data)
    again = Cutter(data, cutter.cuts, cache)
    assert cache.hits >= len(again.starts)
    lying = ChunkCache()
    lying.summaries(data, cutter.starts, cutter.ends, np.zeros(len(cutter.starts), dtype=np.uint64))
    checked = lying.summaries(data, cutter.starts, cutter.ends, np.zeros(len(cutter.starts), dtype=np.uint64))
    assert (checked.words == fill_middle.summarise(data, cutter.starts, cutter.ends)[:, 0]).all()
    small = ChunkCache(limit=3000)
    assert (Cutter(data, cutter.cuts, small).tokens == cutter.tokens).all() and small.held <= 20_000
