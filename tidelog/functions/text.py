"""Small text and time columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` evaluated once, for expressions that use a costly input many times."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def squash(column: Column) -> Column:
    """Collapse Unicode whitespace runs to one blank and strip the ends."""
    return F.regexp_replace(F.regexp_replace(column, r"(?U)\s+", " "), r"^ | $", "")


def same_words(left: Column, right: Column) -> Column:
    """Equality after whitespace normalisation; null on either side stays null."""
    return squash(left) == squash(right)


def iso_millis(column: Column) -> Column:
    """Millisecond UTC stamp with a ``Z`` suffix (the session time zone must be UTC)."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds, exact to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1_000_000.0)


def humanize(seconds: Column) -> Column:
    """Seconds as text with one decimal at most, in the largest unit that keeps it above one."""

    def one_decimal(value: Column) -> Column:
        return F.format_string("%.1f", F.bround(value, 1))

    return (
        F.when(seconds < 90, F.concat(seconds.cast("bigint").cast("string"), F.lit(" second(s)")))
        .when(seconds < 5400, F.concat(F.bround(seconds / 60).cast("bigint").cast("string"), F.lit(" minute(s)")))
        .when(seconds < 172_800, F.concat(one_decimal(seconds / 3600), F.lit(" hour(s)")))
        .otherwise(F.concat(one_decimal(seconds / 86_400), F.lit(" day(s)")))
    )


def redact(column: Column, terms: Iterable[str]) -> Column:
    """Literal replacement, longest term first."""
    for term in sorted(terms, key=len, reverse=True):
        column = F.replace(column, F.lit(term), F.lit("[REDACTED]"))
    return column


def event_watch_kind(value: Column) -> Column:
    """``kind@host`` -> kind; an empty kind means the notable set."""
    kind = F.trim(F.split_part(value, F.lit("@"), F.lit(1)))
    return F.when(kind == "", F.lit("notable")).otherwise(kind)


def event_watch_host(value: Column) -> Column:
    """``kind@host`` -> host (everything after the first ``@``); empty means any host."""
    at = F.instr(value, "@")
    host = F.trim(F.when(at > 0, value.substr(at + 1, F.length(value))))
    return F.when(host != "", host)
