"""Registered queries: name -> (Spark plan, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_MODULES = ("history", "state", "extract", "graph", "frontier", "lookup", "alerts", "operations", "exports", "records", "live", "reprocess", "vectors")


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in _MODULES:
        try:
            module = import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__name__}.{name}":
                raise
            continue
        for key, query in module.QUERIES.items():
            if key in found:
                raise ValueError(f"duplicate query {key}")
            found[key] = query
    return found
