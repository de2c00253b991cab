"""Evidence manifests and their verification, case exhibits and chronology."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import hostname
from ..functions.predicates import retained
from ..functions.text import redact
from ..session import Scratch


def _member(kind: str, historical: bool) -> Column:
    # Versions of one page have members of their own.
    key = F.concat("url", F.lit(" "), F.col("version_id").cast("string")) if historical else F.col("url")
    return F.concat(F.lit("pages/"), F.sha2(key, 256), F.lit("."), F.lit(kind))


def manifest(pages: DataFrame, indicators: DataFrame | None = None, historical: bool = False) -> DataFrame:
    """One manifest row per captured page (or per version, which never carries current indicators).

    ``pages``: ``url, title, content, html, raw_body, content_sha256, body_truncated, content_captured_at, fetched_at``; versions
    also ``version_id, legacy, capture_metadata`` (JSON, given back as ``collector``).  Hashes are computed where the bytes are;
    the bytes do not travel on.
    """
    body_hash = F.sha2("raw_body", 256)
    has_body, has_html = F.col("raw_body").isNotNull(), F.coalesce(F.col("html") != "", F.lit(False))
    verified = F.coalesce(has_body & (body_hash == F.col("content_sha256")), F.lit(False))
    rows = pages if historical else pages.filter(retained())
    source = (
        F.lit("retained_version")
        if historical
        else F.when(F.col("content_captured_at").isNotNull(), "successful_capture").otherwise("legacy_last_fetch_unverified")
    )
    version = [F.col("version_id"), F.col("legacy"), F.from_json("capture_metadata", "map<string,string>").alias("collector")] if historical else []
    out = rows.select(
        "url",
        hostname(F.col("url")).alias("hostname"),
        *version,
        "title",
        F.coalesce("content_captured_at", "fetched_at").alias("fetched_at"),
        source.alias("timestamp_source"),
        F.col("content_sha256").alias("body_sha256"),
        F.col("body_truncated").alias("truncated"),
        _member("txt", historical).alias("text_file"),
        F.sha2(F.coalesce("content", F.lit("")), 256).alias("text_sha256"),
        F.when(has_html, _member("html", historical)).alias("html_file"),
        F.when(has_html, F.sha2("html", 256)).alias("html_sha256"),
        F.when(has_body, _member("body", historical)).alias("body_file"),
        verified.alias("body_verifiable"),
        (verified & F.coalesce(~F.col("body_truncated"), F.lit(False))).alias("complete_body_verifiable"),
    )
    if historical or indicators is None:
        return out
    found = indicators.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_list(F.struct("ioc_type", "value"))).alias("indicators"))
    return out.join(found, "url", "left")


def artefacts(pages: DataFrame, historical: bool = False) -> DataFrame:
    """``(name, bytes)`` members that a manifest over the same pages refers to; pages that are not retained have none."""
    parts = F.array_compact(
        F.array(
            F.struct(_member("txt", historical).alias("name"), F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("bytes")),
            F.when(F.coalesce(F.col("html") != "", F.lit(False)), F.struct(_member("html", historical).alias("name"), F.encode("html", "UTF-8").alias("bytes"))),
            F.when(F.col("raw_body").isNotNull(), F.struct(_member("body", historical).alias("name"), F.col("raw_body").alias("bytes"))),
        )
    )
    rows = pages if historical else pages.filter(retained())
    return rows.select(F.explode(parts).alias("p")).select("p.*")


def checksums(members: DataFrame) -> DataFrame:
    return members.select("name", F.sha2("bytes", 256).alias("sha256"))


def verify_manifest(rows: DataFrame, members: DataFrame, listed: DataFrame) -> DataFrame:
    """Violations ``(name, problem)`` of a manifest, its members and its checksum list; none means consistent."""
    # Every body is hashed once; the checks below read the narrow table.
    actual = Scratch(rows.sparkSession).cut(checksums(members), "checksums")
    both = actual.withColumnRenamed("sha256", "_actual").join(listed.withColumnRenamed("sha256", "_listed"), "name", "full")
    problem = (
        F.when(F.col("_actual").isNull(), "listed but missing")
        .when(F.col("_listed").isNull(), "present but not listed")
        .when(F.col("_actual") != F.col("_listed"), "checksum mismatch")
    )
    sets = both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("name", "problem")

    def claim(kind: str, wanted: str) -> DataFrame:
        claims = rows.filter(F.col(f"{kind}_file").isNotNull()).select(F.col(f"{kind}_file").alias("name"), F.col(wanted).alias("_wanted"))
        return (
            claims.join(actual, "name", "left")
            .filter(~F.coalesce(F.col("sha256") == F.col("_wanted"), F.lit(False)))
            .select("name", F.lit(f"{kind} does not match the manifest").alias("problem"))
        )

    bodies = rows.join(actual.select(F.col("name").alias("body_file"), F.col("sha256").alias("_body")), "body_file", "left")
    matches = F.coalesce(F.col("_body") == F.col("body_sha256"), F.lit(False))
    whole = matches & F.coalesce(~F.col("truncated"), F.lit(False))
    wrong = (F.col("body_verifiable") != matches) | (F.col("complete_body_verifiable") != whole)
    subject = F.concat_ws(" ", "url", F.col("version_id").cast("string")) if "version_id" in rows.columns else F.col("url")
    claims = bodies.filter(wrong).select(subject.alias("name"), F.lit("inconsistent verification claim").alias("problem"))
    return sets.unionByName(claim("text", "text_sha256")).unionByName(claim("html", "html_sha256")).unionByName(claim("body", "body_sha256")).unionByName(claims)


def same_members(left: DataFrame, right: DataFrame, column: str = "name") -> DataFrame:
    """Members on one side only; empty means the sets are equal."""
    a, b = left.select(column), right.select(column)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def exhibits(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Case items with their captures; a capture removed by retention stays listed as unavailable."""
    v = versions.select("version_id", "captured_at", "title", "content", "body_sha256", "body_truncated")
    return items.join(v.withColumn("_there", F.lit(True)), "version_id", "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")


def chronology(items: DataFrame, versions: DataFrame, terms: Iterable[str] = ()) -> DataFrame:
    """Exhibits of each case in capture order with redacted text.

    Order is a column, not a sort of one task: ``captured_at`` (unknown first), then ``item_id``.
    """
    terms = list(terms)
    if any(not t.strip() or len(t) > 512 for t in terms):
        raise ValueError("each redaction term needs 1 to 512 characters and must not be blank")
    return exhibits(items, versions).select(
        "case_id",
        "item_id",
        "version_id",
        "captured_at",
        "available",
        redact(F.col("page_url"), terms).alias("source"),
        redact(F.coalesce("verdict", F.lit("")), terms).alias("assessment"),
        redact(F.coalesce("notes", F.lit("")), terms).alias("interpretation"),
        redact(F.coalesce("content", F.lit("")), terms).alias("excerpt"),
        F.when(F.col("available"), F.lit("")).otherwise("Capture unavailable: removed by retention or policy").alias("remark"),
    )
