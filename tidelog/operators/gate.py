"""Ingest gate: decides what may be stored before anything is written."""

from __future__ import annotations

import re
import string
import warnings
from collections.abc import Iterator
from re import _constants as re_constants
from re import _parser as re_parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import MEDIA_PREFIXES
from ..session import Scratch
from .literals import literal_matches

# Rules tested by one expression; longer lists take several expressions in the same projection chain.
RULES_PER_BLOCK = 100
# Rules that are plain characters, between word bounds or not, hold only where those characters are.
_PLAIN = re.compile(r"(?:\\b)?([A-Za-z0-9_ ]+)(?:\\b)?")
# Letters that match an ASCII letter whatever the case, besides its own two forms.
_FOLDED = ("\u017f\u0131\u0130\u212a", "siik")
_FACTOR_CHARS = frozenset(string.ascii_letters + string.digits + " _-")
_NO_CATEGORIES = "cast(array() as array<string>)"


def content_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def _decide(rows: DataFrame, matched: Column, store_media: bool) -> DataFrame:
    media = F.lit(False)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    for prefix in MEDIA_PREFIXES:
        media = media | kind.startswith(prefix)
    bad, hit = F.col("_bad"), F.size(matched) > 0
    return rows.withColumn(
        "decision",
        F.struct(
            F.when(bad, False).when(media, store_media).otherwise(~hit).alias("store_content"),
            (bad | (~media & hit)).alias("blocked"),
            F.when(bad, "known-bad-hash").when(media, "media").when(hit, "blocklist").alias("reason"),
            F.when(bad, F.array(F.lit("known-bad-hash")))
            .when(~media & hit, matched)
            .otherwise(F.expr(_NO_CATEGORIES))
            .alias("categories"),
        ),
    )


def _near(hay: Column, plain: list[tuple[int, str, str, str]]) -> Column:
    """Rules ``(at, category, pattern)`` whose plain characters stand in the text, found in one pass over it by an automaton."""

    @F.pandas_udf("array<struct<at: int, category: string, pattern: string>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules: dict[str, list] = {}
        for at, category, pattern, literal in plain:
            rules.setdefault(literal.lower(), []).append({"at": at, "category": category, "pattern": pattern})
        automaton = ahocorasick.Automaton()
        for literal in rules:
            automaton.add_word(literal, literal)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([[] if t is None else [r for literal in {x for _, x in automaton.iter(t)} for r in rules[literal]] for t in texts], dtype="object")

    return look(F.lower(F.translate(hay, *_FOLDED)))


def gate(pages: DataFrame, rules: DataFrame, known_bad: DataFrame, store_media: bool = False) -> DataFrame:
    """Add struct ``decision(store_content, blocked, reason, categories)``.

    ``pages``: ``url, text, content_type, content_sha256``; ``rules``: ``position, category, pattern``; ``known_bad``:
    ``sha256``.  Precedence: known-bad hash, then media, then rules, then store.
    """
    bad = known_bad.select(F.lower("sha256").alias("_sha")).distinct().withColumn("_known", F.lit(True))
    rows = (
        pages.join(bad, F.lower("content_sha256") == F.col("_sha"), "left")
        .withColumn("_bad", F.coalesce("_known", F.lit(False)))
        .drop("_sha", "_known")
    )
    haystack = F.concat("url", F.lit("\n"), F.coalesce("text", F.lit("")))
    # The rules are configuration.  Every row is matched by itself, whatever their number, so the plan has no join and streams.
    listed = rules.orderBy("position").collect()
    rows = rows.withColumn("_hay", haystack)
    # Of a long list, the rules of plain characters are tested only where those characters occur; the others on every row.
    plain = [(at, r["category"], r["pattern"], m[1]) for at, r in enumerate(listed) if (m := _PLAIN.fullmatch(r["pattern"]))] if len(listed) > RULES_PER_BLOCK else []
    looked = {at for at, *_ in plain}
    rest = [(at, r) for at, r in enumerate(listed) if at not in looked]
    blocks = []
    for k in range(0, len(rest), RULES_PER_BLOCK):
        hits = [F.when(F.col("_hay").rlike("(?iU)" + r["pattern"]), F.struct(F.lit(at).alias("at"), F.lit(r["category"]).alias("category"))) for at, r in rest[k : k + RULES_PER_BLOCK]]
        blocks.append(f"_block{k}")
        rows = rows.withColumn(blocks[-1], F.array_compact(F.array(*hits)))
    if plain:
        rows = rows.withColumn("_near", _near(F.col("_hay"), plain))
        met = F.filter("_near", lambda r: F.rlike(F.col("_hay"), F.concat(F.lit("(?iU)"), r["pattern"])))
        blocks += ["_near", "_met"]
        rows = rows.withColumn("_met", F.transform(met, lambda r: F.struct(r["at"].alias("at"), r["category"].alias("category"))))
    found = [b for b in blocks if b != "_near"]
    in_order = F.transform(F.array_sort(F.concat(*found)), lambda r: r["category"]) if found else None
    matched = F.filter(in_order, lambda c: c.isNotNull()) if found else F.expr(_NO_CATEGORIES)
    decided = _decide(rows.withColumn("_matched", matched), F.col("_matched"), store_media)
    return decided.drop("_bad", "_hay", "_matched", *blocks)


def required_literal(pattern: str) -> str | None:
    """The longest run of ASCII letters, digits, blanks, ``_`` and ``-`` that every match of ``pattern`` contains, in lower case.

    None where there is no run of three, or where the pattern uses what Python's parser reads in another way than Java's.
    """
    if re.search(r"\(\?(?!:)|\[[^\]]*\[|&&|\\[QEzZGRXhHvVpPNxuck0-9]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = re_parser.parse(pattern)
    except (re.error, Warning, RecursionError, OverflowError):
        return None
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is re_constants.LITERAL and chr(value) in _FACTOR_CHARS:
                runs[-1] += chr(value).lower()
            elif op is re_constants.SUBPATTERN:
                walk(value[3])
            elif op is re_constants.AT and value in (re_constants.AT_BOUNDARY, re_constants.AT_NON_BOUNDARY):
                continue
            else:
                runs.append("")
                if op in (re_constants.MAX_REPEAT, re_constants.MIN_REPEAT, re_constants.POSSESSIVE_REPEAT) and value[0] >= 1:
                    walk(value[2])  # one of the repeats, apart from what stands around them
                    runs.append("")

    walk(parsed)
    longest = max(runs, key=len)
    return longest if len(longest) >= 3 else None


@F.pandas_udf(StringType())
def _required(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for patterns in batches:
        yield pd.Series([None if p is None else required_literal(p) for p in patterns], dtype="object")


def gate_by_table(pages: DataFrame, rules: DataFrame, known_bad: DataFrame, store_media: bool = False) -> DataFrame:
    """``gate`` for stored pages and a table of rules of any number.

    A rule that needs some characters in every match is looked up by them, and its pattern is tried on the pages that hold them.  The
    rules that need none are the only ones listed by the driver and tried on every page.
    """
    scratch = Scratch(pages.sparkSession, keep=8)
    haystack = F.concat("url", F.lit("\n"), F.coalesce("text", F.lit("")))
    # The text is stored once; what is searched is made from it where it is read.
    rows = scratch.cut(pages.withColumn("_row", F.monotonically_increasing_id()), "pages").withColumn("_hay", haystack)
    listed = scratch.cut(rules.select(F.monotonically_increasing_id().alias("literal_id"), "position", "category", "pattern", _required.asNondeterministic()("pattern").alias("literal")), "rules")
    texts = rows.select(F.col("_row").alias("text_id"), F.lower(F.translate("_hay", *_FOLDED)).alias("text"), "_hay")
    known = listed.filter("literal IS NOT NULL")
    hit = literal_matches(texts, known.select("literal_id", "literal", "pattern"), scratch, F.rlike("_hay", F.concat(F.lit("(?iU)"), F.col("pattern"))))
    found = hit.join(known.select("literal_id", "position", "category"), "literal_id").select(F.col("text_id").alias("_row"), "position", "literal_id", "category")
    # One row a page: a page meets each rule at most once.
    by_page = scratch.cut(found.groupBy("_row").agg(F.collect_list(F.struct("position", F.col("literal_id").alias("at"), "category")).alias("_by_literal")), "found")
    rest = listed.filter("literal IS NULL AND pattern IS NOT NULL").orderBy("position", "literal_id").collect()
    tried, blocks = rows, []
    for k in range(0, len(rest), RULES_PER_BLOCK):
        hits = [F.when(F.col("_hay").rlike("(?iU)" + r["pattern"]), F.struct(F.lit(r["position"]).alias("position"), F.lit(r["literal_id"]).alias("at"), F.lit(r["category"]).alias("category"))) for r in rest[k : k + RULES_PER_BLOCK]]
        blocks.append(f"_block{k}")
        tried = tried.withColumn(blocks[-1], F.array_compact(F.array(*hits)))
    none = F.expr(f"cast(array() as {by_page.schema['_by_literal'].dataType.simpleString()})")
    joined = tried.join(by_page, "_row", "left")
    in_order = F.array_sort(F.concat(F.coalesce("_by_literal", none), *blocks))
    joined = joined.withColumn("_matched", F.filter(F.transform(in_order, lambda r: r["category"]), lambda c: c.isNotNull()))
    bad = known_bad.select(F.lower("sha256").alias("_sha")).distinct().withColumn("_known", F.lit(True))
    marked = joined.join(bad, F.lower("content_sha256") == F.col("_sha"), "left").withColumn("_bad", F.coalesce("_known", F.lit(False)))
    return _decide(marked, F.col("_matched"), store_media).select(*pages.columns, "decision")


def storable(gated: DataFrame) -> DataFrame:
    """Rows as they may be written: the text survives only where the decision allows it."""
    return gated.withColumns(
        {
            "text": F.when(F.col("decision.store_content"), F.col("text")),
            "blocked": F.col("decision.blocked"),
            "blocked_reason": F.array_join("decision.categories", ","),
        }
    ).drop("decision")
