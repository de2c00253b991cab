"""Learned decision lists over text statistics: sequential covering in DataFrame aggregations, applied as one CASE expression.

Rules that reject are grown one at a time on two thirds of the labelled rows.  Each literal is a threshold on one statistic,
chosen by FOIL gain from one aggregation of (statistic, bin) counts; a grown conjunction is cut back to the prefix that does
best on the other third, and learning stops at the first rule that is not precise enough there.  The list is an ordered
``CASE WHEN`` over columns; texts that no rule catches are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BINS = 64
MAX_RULES = 12
MAX_LITERALS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 10


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts and the shares that rules may test; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    n = F.size("_words")
    docs = docs.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "_threes": F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
            ),
            "_upper": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "_marks": F.length(text) - F.length(F.translate(text, "!?", "")),
            "_digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
            "_distinct": F.size(F.array_distinct("_words")),
        }
    )
    repeated = F.size(F.array_distinct("_threes")) < F.size("_threes")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    docs = docs.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_sorted": F.when(repeated, F.sort_array(F.transform("_threes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty),
        }
    )
    same = lambda x, at: F.coalesce(F.get("_sorted", at)["h"] == x["h"], F.lit(False))
    docs = docs.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["total"] + s + 3 - F.greatest(acc["end"], s)).alias("total"), (s + 3).alias("end")),
        lambda acc: acc["total"],
    )
    docs = docs.withColumn("n_repeat_words", covered.cast("long"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return docs.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("_upper") / chars,
            "mark_share": F.col("_marks") / words,
            "digit_share": F.col("_digits") / chars,
            "distinct_share": F.col("_distinct") / words,
            "line_words": F.col("n_words") / F.greatest(F.col("_n_lines"), F.lit(1)),
        }
    ).drop("_words", "_lines", "_threes", "_sorted", "_starts", "_upper", "_marks", "_digits", "_distinct", "_n_lines")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def rule_column(rule: tuple[Literal, ...]) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def verdict(rules: list[tuple[Literal, ...]]) -> Column:
    """Number of the first rule that rejects a row, from 1; null where none does."""
    fired = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(rule_column(rule), F.lit(number)).otherwise(fired)
    return fired


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best_literal(rows: DataFrame, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[Literal, int, int] | None:
    """The literal of most gain, from the counts of each bin of each statistic: at most ``len(cuts) * (BINS + 1)`` rows."""

    def bin_of(feature: str) -> Column:
        return F.size(F.filter(F.lit(cuts[feature]).cast("array<double>"), lambda t: t < F.col(feature)))

    binned = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in cuts]))
    counts = rows.select("bad", binned.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best: tuple[float, str, bool, float, int, int] | None = None
    for feature, thresholds in cuts.items():
        below = [(0, 0)] * (len(thresholds) + 1)
        for r in counts:
            if r["f"] == feature:
                below[r["b"]] = (r["p"], r["n"])
        p = n = 0
        for i, threshold in enumerate(thresholds):
            p, n = p + below[i][0], n + below[i][1]
            for above, got in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = _gain(p0, n0, *got)
                choice = (gain, feature, above, threshold, *got)
                if gain > 0 and got[0] >= MIN_COVERED and (best is None or choice[:3] > best[:3]):
                    best = choice
    return (Literal(best[1], best[2], best[3]), best[4], best[5]) if best else None


def learn_rules(labelled: DataFrame, scratch: Scratch, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[tuple[Literal, ...]]:
    """Rules that reject, from rows with the statistics, ``bad`` (1: reject) and ``prune`` (true: held for cutting back)."""
    labelled = scratch.cut(labelled.select("bad", "prune", *FEATURES), "labelled")
    steps = [i / BINS for i in range(1, BINS)]
    row = labelled.select(*[F.percentile_approx(F.col(f).cast("double"), steps, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    cuts = {f: c for f, c in cuts.items() if c}
    rules: list[tuple[Literal, ...]] = []
    left = labelled
    while cuts and len(rules) < max_rules:
        grown = left.filter(~F.col("prune"))
        total = grown.agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        p, n = total["p"] or 0, total["n"] or 0
        if p < MIN_COVERED or not n:
            break
        rule: tuple[Literal, ...] = ()
        while n and len(rule) < MAX_LITERALS and (found := _best_literal(grown, cuts, p, n)):
            literal, p, n = found
            rule += (literal,)
            grown = grown.filter(literal.column())
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        held = left.filter("prune").agg(*[F.sum(F.when(rule_column(h), F.col("bad"))).alias(f"p{i}") for i, h in enumerate(heads)], *[F.sum(F.when(rule_column(h), 1 - F.col("bad"))).alias(f"n{i}") for i, h in enumerate(heads)]).first()
        value = lambda i: ((held[f"p{i}"] or 0) - (held[f"n{i}"] or 0)) / max(1, (held[f"p{i}"] or 0) + (held[f"n{i}"] or 0))  # noqa: B023, E731
        best = max(range(len(heads)), key=lambda i: (value(i), -i))
        p, n = held[f"p{best}"] or 0, held[f"n{best}"] or 0
        if not p or p < min_precision * (p + n):
            break
        rules.append(heads[best])
        left = left.filter(~rule_column(heads[best]))
    return rules


def labelled_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Statistics of labelled rows that pass the base rules; a label given twice counts by its largest quality."""
    quality = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    quality = quality.select(F.col("doc_id").alias("_id"), "_quality")
    rows = stats.filter(~F.col("base_failed")).join(quality, F.col(id_col) == F.col("_id"))
    return rows.select((F.col("_quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(3)) == 0).alias("prune"), *FEATURES)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule)``, one row per input row.

    The rules are learned from every labelled row; without labels, or with one class only, the base rules alone decide.
    ``rule`` is the number of the learned rule that rejects the row.  A null or empty text has counts of 0 and fails the base
    rules.  Rows that repeat an id are judged alike; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    stats = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    stats = scratch.cut(stats, "statistics")
    rules = learn_rules(labelled_statistics(stats, labels), scratch)
    rule = F.when(~F.col("base_failed"), verdict(rules))
    return stats.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & rule.isNull()).alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the learned list, with the columns of ``docs``.

    Rows and their statistics are stored together, so each text is measured once and judged from the stored table.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = with_statistics(docs.select(whole, F.col(f"`{text_col}`").alias("text")), "text").drop("text")
    stored = scratch.cut(measured, "measured")
    rules = learn_rules(labelled_statistics(stored.withColumn("doc_id", F.col(f"row.`{id_col}`")), labels), scratch)
    return stored.filter(~F.col("base_failed") & verdict(rules).isNull()).select("row.*")
