import hashlib
import math

import numpy as np
import pytest

from tidelog.llm.centroids import cluster, quantized, reassign, squared_distances

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(q) for _, q in sorted(kept, key=key)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(q)) for i, q in kept]
    per = {}
    for _, d, j in found:
        per[j] = per.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for i, d, j in found), key=str)


def mixture(seed, n, dims=64, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (7, dims))
    return [(i, (centers[i % 7] + rng.normal(0, spread, dims)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_plain_rounds_with_odd_rows(spark):
    rows = mixture(1, 300)
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies: ties between centroids that are equal
    rows += [(5, rows[9][1]), (None, rows[3][1]), (400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65)]
    rows += [(404, [float("nan")] + [0.0] * 63), (405, [float("inf")] + [0.0] * 63), (406, [None] + [0.0] * 63), (407, [30000.0] * 64), (408, [-1e6] + [0.1] * 63)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, q int").repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((16, 3), (1, 2), (4, 6)):
        got = cluster(df, k, rounds, "1", 64, 64)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(rows, k, rounds)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = mixture(2, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in cluster(df, 16, 3, "1", 64, 64).collect()), key=str) == brute(rows, 16, 3)
    assert cluster(df.limit(0), 16, 3, "1", 64, 64).count() == 0


def test_bounds_save_work_and_never_change_the_answer():
    rng = np.random.default_rng(5)
    q = rng.integers(-70, 70, (3000, 64)) + 200 * rng.integers(-1, 2, (3000, 1))
    history = [q[:12].copy()]
    seen = squared_distances(q, history[0])
    at, assigned, share = np.zeros_like(seen), seen.argmin(1), []
    for _ in range(8):
        moved = [q[assigned == j].sum(0) // max(1, (assigned == j).sum()) if (assigned == j).any() else history[-1][j] for j in range(12)]
        history.append(np.array(moved))
        assigned, evaluated = reassign(q, np.stack(history), assigned, seen, at)
        assert (assigned == squared_distances(q, history[-1]).argmin(1)).all()
        share.append(evaluated.sum() / seen.size)
    assert share[-1] < 0.5


def test_large_components_stay_exact(spark):
    q = np.array([[1 << 27] * 64, [-(1 << 27)] * 64, [3] * 64], dtype=np.int64)
    assert squared_distances(q, q)[0].tolist() == [0, 64 << 56, 64 * ((1 << 27) - 3) ** 2]
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-0.01] * 64)], "vec_id long, embedding array<double>")
    assert [r.q[0] for r in quantized(df, 64, 64).orderBy("vec_id").collect()] == [1 << 27, -1]


@pytest.mark.parametrize("seed", [3, 4])
def test_random_small_components_with_many_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-1, 2, 64) / 64.0).tolist()) for i in rng.permutation(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in cluster(df, 16, 3, "1", 64, 64).collect()), key=str) == brute(rows, 16, 3)
