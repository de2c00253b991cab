import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm.bin_completion import best_fit, lower_bound, pack_lengths, undominated
from tidelog.llm.packing import pack_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def checked(counts, capacity, packing):
    got = np.zeros(capacity + 1, dtype=np.int64)
    for filling, times in packing.fillings:
        assert times > 0 and sum(length * count for length, count in filling) <= capacity
        for length, count in filling:
            got[length] += count * times
    assert (got == counts).all()
    assert sum(n for _, n in packing.fillings) == packing.sequences >= packing.bound


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, room in enumerate(bins):
            if room >= items[i] and room not in bins[:j]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_fewest_sequences_on_small_inputs():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([7, 12, 20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        packing = pack_lengths(counts, capacity, nodes=5000, width=10**6, steps=10**6)
        checked(counts, capacity, packing)
        assert packing.sequences == optimum(items, capacity) >= lower_bound(counts, capacity)


def test_search_beats_best_fit():
    # Best fit puts the two nines together; 9 + 7 + 4, 9 + 7 + 3 and 7 + 7 + 5 need one sequence less.
    counts = np.bincount([9, 9, 7, 7, 7, 7, 5, 4, 3], minlength=21)
    assert sum(n for _, n in best_fit(counts, 20)) == 4
    packing = pack_lengths(counts, 20)
    checked(counts, 20, packing)
    assert packing.sequences == 3


def test_dominated_fillings_are_skipped():
    counts = np.bincount([5, 3, 2, 2, 1], minlength=8)
    assert list(undominated(counts, 5, 10, 1000)) == [((5, 1),)]
    assert all(sum(a * b for a, b in f) == 7 for f in undominated(counts, 7, 10, 1000))


@pytest.mark.parametrize("count", [100, 3000, 200_000])
def test_large_histograms(count):
    lengths = np.clip(np.exp(np.random.default_rng(count).normal(5.5, 1.2, count)).astype(int) + 1, 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    packing = pack_lengths(counts, 2048, nodes=40)
    checked(counts, 2048, packing)
    assert packing.sequences <= packing.bound * 1.001 + 1


def test_pieces_equal_the_library_and_fill_sequences_without_gaps(spark):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "a"), (3, "b b"), (None, "no id"), (None, None), (7, "word " * 127), (8, "word " * 128), (9, "x y" * 900), (10, "é" * 999)]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "be", "c", "delta7", "日本"]) for _ in range(rng.randrange(0, 150)))) for i in range(250)]
    rows += [(1000 + i, "copies of one text") for i in range(120)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, ids string, length int").repartition(6)
    library = Tokenizer.from_file(BYTES)
    want = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 128 + 1
        for piece, low in enumerate([0, *range(first, len(ids), 128)]):
            part = ids[low : first + 128 * piece]
            want.append((key, piece, low, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), np.array(part, dtype="<u2").tobytes()))
    packed, plan = pack_documents(df, BYTES, 0, 128)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) == plan.sequences and sorted(by) == list(range(plan.sequences))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128


def test_empty_table(spark):
    packed, plan = pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTES, 0, 64)
    assert packed.count() == 0 and plan.sequences == 0
