"""Lookups on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than 1/HOT_SHARE of the rows is hot, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000
# Below this many rows a single task can hold any key, and looking for hot keys costs more than it saves.
SKEW_FLOOR = 5_000_000


def hot_keys(df: DataFrame, key: str, total: int) -> DataFrame:
    """Keys of ``df`` with more than ``total / HOT_SHARE`` rows: at most ``HOT_SHARE`` rows by arithmetic."""
    threshold = max(total // HOT_SHARE, 1)
    return df.groupBy(key).count().filter(F.col("count") > threshold).select(key)


def join_lookup(big: DataFrame, key: str, lookup: DataFrame, total: int, floor: int = SKEW_FLOOR) -> DataFrame:
    """Inner join of ``big`` to ``lookup`` (one row per key) that never gathers a hot key in one task.

    Rows of hot keys meet a broadcast of the at most ``HOT_SHARE`` matching lookup rows and are not shuffled; the other
    rows take an ordinary shuffle join.
    """
    if total < floor:
        return big.join(lookup, key)
    hot = F.broadcast(hot_keys(big, key, total))
    hot_part = big.join(F.broadcast(lookup.join(hot, key, "left_semi")), key)
    cold_part = big.join(hot, key, "left_anti").join(lookup, key)
    return hot_part.unionByName(cold_part)
