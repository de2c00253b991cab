"""Extraction quality against labelled samples, reviewed examples, and host packs from observed evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import is_publishable
from ..schemas import STRONG_TYPES


def set_metrics(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives and false negatives of two row sets, with precision and recall per group.

    Both sides are reduced to distinct keys, tagged and counted in one aggregation: no join is needed.
    """
    tagged = predicted.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(gold.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_g")))
    per_key = tagged.groupBy(*keys).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))
    counts = per_key.groupBy(*groups).agg(
        F.count_if((F.col("_p") == 1) & (F.col("_g") == 1)).alias("true_positive"),
        F.count_if((F.col("_p") == 1) & (F.col("_g") == 0)).alias("false_positive"),
        F.count_if((F.col("_p") == 0) & (F.col("_g") == 1)).alias("false_negative"),
    )
    tp = F.col("true_positive")
    return counts.withColumns(
        {"precision": F.try_divide(tp, tp + F.col("false_positive")), "recall": F.try_divide(tp, tp + F.col("false_negative"))}
    )


def errors(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows only one side has, marked as false positive or false negative."""
    p, g = predicted.select(*keys), gold.select(*keys)
    return (
        p.subtract(g).withColumn("error", F.lit("false_positive")).unionByName(g.subtract(p).withColumn("error", F.lit("false_negative")))
    )


def review_outcomes(examples: DataFrame, found: DataFrame) -> DataFrame:
    """Whether each reviewed value is still (or no longer) extracted.

    ``examples``: ``review_id, expected, verdict``; ``found``: ``review_id, value`` from the re-run extractors.  A false
    positive passes when the value is gone; every other verdict passes when it is there.
    """
    hits = found.select("review_id", F.coalesce("value", F.lit("")).alias("expected")).distinct().withColumn("_found", F.lit(True))
    joined = examples.join(hits, ["review_id", "expected"], "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")
    return joined.withColumn("passed", F.when(F.col("verdict") == "false_positive", ~F.col("found")).otherwise(F.col("found")))


def pass_rate(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))


def regression_examples(feedback: DataFrame, versions: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """Reviewed examples with their page text; ``limit`` keeps the first by id, ``chars`` the head of each text."""
    v = versions.select("version_id", "content", "body_sha256")
    rows = feedback.join(v, "version_id")
    if limit is not None:
        rows = rows.orderBy("review_id").limit(limit)
    text = F.coalesce("content", F.lit(""))
    return rows.select(
        "review_id", "extractor", F.col("value").alias("expected"), "verdict", (text if chars is None else F.substring(text, 1, chars)).alias("text"), "body_sha256", "reason"
    )


def host_evidence(state: DataFrame, listings: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per host: pages that answered, last fetch, title, listings and strong identifiers.

    Records are counted per page first, so a page table row is never multiplied.
    """
    per_listing = listings.groupBy(F.col("page_url").alias("url")).agg(F.count(F.lit(1)).alias("_l"))
    per_ident = (
        indicators.filter(F.col("ioc_type").isin(*STRONG_TYPES)).groupBy(F.col("page_url").alias("url")).agg(F.count(F.lit(1)).alias("_i"))
    )
    crawled = F.col("status") == "crawled"
    return (
        state.filter(F.col("hostname").isNotNull())
        .select("url", "hostname", "status", "fetched_at", "title")
        .join(per_listing, "url", "left")
        .join(per_ident, "url", "left")
        .groupBy("hostname")
        .agg(
            F.count_if(crawled).alias("pages"),
            F.max(F.when(crawled, F.col("fetched_at"))).alias("last_seen"),
            F.coalesce(F.sum("_l"), F.lit(0)).alias("listings"),
            F.coalesce(F.sum("_i"), F.lit(0)).alias("identifiers"),
            F.substring(F.trim(F.coalesce(F.min(F.when(crawled, F.col("title"))), F.lit(""))), 1, 80).alias("title"),
        )
        .filter(F.col("pages") > 0)
    )


def host_packs(evidence: DataFrame, min_pages: int = 1) -> DataFrame:
    """Pack rows ``(pack, hostname, url, note, last_seen, evidence, weight)`` of publishable hosts."""
    rows = evidence.filter(is_publishable(F.col("hostname")))

    def pack(name: str, condition, weight: str, text: str) -> DataFrame:
        return rows.filter(condition).select(
            F.lit(name).alias("pack"),
            "hostname",
            F.concat(F.lit("http://"), "hostname", F.lit("/")).alias("url"),
            F.col("title").alias("note"),
            F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"),
            F.concat(F.col(weight).cast("string"), F.lit(text)).alias("evidence"),
            F.col(weight).alias("weight"),
        )

    shops = pack("commerce", F.col("listings") >= 3, "listings", " listing(s) extracted")
    people = pack("actor-infrastructure", (F.col("identifiers") >= 2) & (F.col("listings") < 3), "identifiers", " actor identifier(s) extracted")
    live = pack("verified-live", F.col("pages") >= min_pages, "pages", " page(s) fetched successfully")
    return shops.unionByName(people).unionByName(live)
