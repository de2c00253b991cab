"""Exact integer k-means with ns-bounds: lower bounds are loosened by the norm of a centroid's total displacement.

A vector remembers, for every centroid, the squared distance of its last evaluation and the round of that evaluation.  The
history of all centroids (rounds x k rows, bounded by the parameters) gives ``|c_now - c_then|``, the norm of the whole way,
which is never more than the sum of the drifts of the rounds between.  A vector whose bounds prove its assignment is not
looked at; of the others exactly the centroids whose bounds fail are evaluated again, in whole numbers.

Vectors are kept by ``quantized``: exactly ``dims`` components, none null or non-finite.  Components become
``floor(scale * x)``, held within +-2^27 so that squared distances fit 64 bits (reached only by ``|x|`` above two million).
A null id ranks last among the candidates for first centroids; rows with equal ids are rows of their own and stand in the
order of their components.  With fewer kept vectors than ``k`` there are fewer centroids; none at all give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .shingles import fixed_lists

LARGEST = 1 << 27
# Up to this size sums of 64 products are whole numbers below 2^53, so that matrix products in doubles are exact.
EXACT_DOUBLE = 1 << 21
STATE = "vec_id long, q array<int>, cluster int, was int, seen array<long>, at array<long>, distance long, evaluated int"


def quantized(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` of the vectors that have ``dims`` finite components."""
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    step = lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.size("v") == dims).filter(~bad).select("vec_id", F.transform("v", step).alias("q"))


def squared_distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids (int64)."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_DOUBLE:
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)


def _pairs(q: np.ndarray, centroids: np.ndarray, rows: np.ndarray, which: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    out = np.empty(len(rows), dtype=np.int64)
    for at in range(0, len(rows), block):
        part = slice(at, at + block)
        out[part] = ((q[rows[part]] - centroids[which[part]]) ** 2).sum(1)
    return out


def reassign(q: np.ndarray, history: np.ndarray, cluster: np.ndarray, seen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of ``history[-1]`` for every row, ties to the smaller number; ``seen`` and ``at`` change in place.

    Returns the clusters and the number of distances evaluated in each row.
    """
    now, k, rows = len(history) - 1, history.shape[1], np.arange(len(q))
    way = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(2))  # round x centroid
    slack = 1e-9
    lower = np.sqrt(seen.astype(np.float64)) * (1 - slack) - way[at, np.arange(k)] * (1 + slack)
    upper = np.sqrt(seen[rows, cluster].astype(np.float64)) * (1 + slack) + way[at[rows, cluster], cluster] * (1 + slack)
    lower[rows, cluster] = np.inf
    failed = np.flatnonzero((lower <= upper[:, None] + slack).any(1))
    evaluated = np.zeros(len(q), dtype=np.int32)
    own = cluster[failed]
    seen[failed, own], at[failed, own] = _pairs(q, history[-1], failed, own), now
    tight = np.sqrt(seen[failed, own].astype(np.float64)) * (1 + slack) + slack
    which, centroid = np.nonzero(lower[failed] <= tight[:, None])
    which = failed[which]
    seen[which, centroid], at[which, centroid] = _pairs(q, history[-1], which, centroid), now
    np.add.at(evaluated, failed, 1)
    np.add.at(evaluated, which, 1)
    fresh = np.where(at[failed] == now, seen[failed], np.iinfo(np.int64).max)
    out = cluster.copy()
    out[failed] = fresh.argmin(1)
    return out, evaluated


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(-1, width)


def _assign(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """One round over all vectors: without bounds in the first round, by ``reassign`` after it."""
    k, dims = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("q"), dims, np.int64)
            if len(history) == 1:
                seen = squared_distances(q, history[0])
                at = np.zeros_like(seen)
                was, cluster = np.full(len(q), -1, dtype=np.int32), seen.argmin(1)
                evaluated = np.full(len(q), k, dtype=np.int32)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int32)
                seen, at = _matrix(batch.column("seen"), k, np.int64), _matrix(batch.column("at"), k, np.int64)
                cluster, evaluated = reassign(q, history, was.astype(np.int64), seen, at)
            distance = pa.array(_pairs(q, history[-1], np.arange(len(q)), cluster)) if last else pa.nulls(len(q), pa.int64())
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32)), pa.array(was)]
            columns += [fixed_lists(seen), fixed_lists(at), distance, pa.array(evaluated)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """What the rows that changed their cluster add to the counts and sums of clusters: at most k rows."""
    side = lambda name, sign: F.struct(F.col(name).alias("c"), F.lit(sign).cast("long").alias("sign"))
    moved = state.filter("cluster <> was").select("q", F.inline(F.array(side("cluster", 1), side("was", -1))))
    sums = moved.filter("c >= 0").groupBy("c").agg(F.sum("sign").alias("n"), *[F.sum(F.col("q")[i] * F.col("sign")).alias(f"s{i}") for i in range(dims)])
    return {row.c: (row.n, [row[f"s{i}"] for i in range(dims)]) for row in sums.collect()}


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``rounds`` rounds of assignment and centroid means, then one more assignment.

    First centroids: the ``k`` kept vectors of smallest sha256 of ``<seed>:<vec_id>``.  A mean is the exact floor of sum by count in
    every component; a cluster without vectors keeps its centroid.  Returns ``(vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, evaluated)``, ``evaluated`` being the distances that the last round had to compute for the row; inertias past
    2^63 - 1 stay there.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    state = quantized(vectors, dims, scale, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, evaluated int")
    history = [np.array([row.q for row in first], dtype=np.int64)]
    totals = [(0, [0] * dims) for _ in first]
    for number in range(rounds + 1):
        state = scratch.cut(_assign(state, np.stack(history), last=number == rounds), "state")
        if number < rounds:
            for c, (n, added) in _sums(state, dims).items():
                totals[c] = totals[c][0] + n, [a + b for a, b in zip(totals[c][1], added, strict=True)]
            history.append(np.array([[s // n for s in sums] if n else old for (n, sums), old in zip(totals, history[-1].tolist(), strict=True)], dtype=np.int64))
    inertia = {row.cluster: int(row.total) for row in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    held = lambda x: min(x, (1 << 63) - 1)
    rows = [
        (c, held(inertia.get(c, 0)), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, final)).encode()).hexdigest())
        for c, final in enumerate(history[-1].tolist())
    ]
    facts = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return state.select("vec_id", "cluster", "distance", "evaluated").join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")
