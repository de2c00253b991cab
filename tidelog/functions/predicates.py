"""Reusable row predicates: each has one definition so that two views can never disagree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STRONG_TYPES


def not_answering() -> Column:
    """Latest fetch failed: dead pages, and crawled pages whose failure count is above zero."""
    failing = F.coalesce(F.col("consecutive_failures"), F.lit(0)) > 0
    return F.coalesce((F.col("status") == "dead") | ((F.col("status") == "crawled") & failing), F.lit(False))


def retained() -> Column:
    """Stored and not blocked.  A null ``blocked`` is unknown and does not count as retained."""
    return F.coalesce(~F.col("blocked"), F.lit(False)) & F.col("content").isNotNull()


def complete_body() -> Column:
    """Known not truncated, with a hash.  Null truncation means unknown, never complete."""
    return F.coalesce(~F.col("body_truncated"), F.lit(False)) & F.col("content_sha256").isNotNull()


def complete_capture() -> Column:
    return retained() & complete_body()


def substantive(min_chars: int = 80) -> Column:
    return F.coalesce(F.length(F.trim("content")) >= min_chars, F.lit(False))


def indicator_types(spec: str | None, column: str = "ioc_type") -> Column:
    """One type, a comma-separated set, the alias ``actor``, or nothing for no restriction."""
    if not spec:
        return F.lit(True)
    if spec == "actor":
        return F.col(column).isin(*STRONG_TYPES)
    return F.col(column).isin(*[part.strip() for part in spec.split(",") if part.strip()])
