"""Order-dependent helpers that never put one whole key into one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to one task, which fails when one page
holds a third of all captures.  The helpers here cut each key into chunks of its order column, work inside
``(key, chunk)``, and carry one summary row per chunk forward.  Only the summaries meet in a per-key window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def time_chunk(column: str, unit: str = "day") -> Column:
    return F.date_trunc(unit, F.col(column))


def id_chunk(column: str, width: int = 1_000_000) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: Sequence[str], into: str
) -> DataFrame:
    """Add struct ``into`` holding ``columns`` of the preceding row of the same key (null for the first)."""
    keyed = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = keyed.withColumn("_here", F.struct(*columns))
    inside = packed.withColumn("_prev", F.lag("_here").over(local)).drop("_here")
    tails = (
        keyed.select(*keys, "_chunk", *[c for c in dict.fromkeys([*order, *columns]) if c not in keys])
        .groupBy(*keys, "_chunk")
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    )
    per_key = Window.partitionBy(*keys).orderBy("_chunk") if keys else Window.orderBy("_chunk")
    carried = tails.withColumn("_carry", F.lag("_tail").over(per_key)).drop("_tail")
    # Renamed copies keep the join an ordinary equi-join and stay null-safe on the keys.
    carried = carried.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_chunk"]], "_carry")
    condition = F.lit(True)
    for k in [*keys, "_chunk"]:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = inside.join(carried, condition, "left")
    return joined.withColumn(into, F.coalesce("_prev", "_carry")).drop(
        "_prev", "_carry", "_chunk", *[f"_k_{k}" for k in [*keys, "_chunk"]]
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank") -> DataFrame:
    """First ``n`` rows of each key.  Spark's group limit keeps ``n`` rows per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rank) <= n
    )
