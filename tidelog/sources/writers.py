"""Writers: every export is a parallel write of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import indicator_types


def write_indicator_csv(indicators: DataFrame, path: str, types: str | None = None) -> None:
    """``type,value,page_url`` with a header."""
    rows = indicators.filter(indicator_types(types)).select(F.col("ioc_type").alias("type"), "value", "page_url")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stix_lines(objects: DataFrame, path: str) -> None:
    """One STIX object per line."""
    objects.select(F.col("object").alias("value")).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_regression_examples(examples: DataFrame, path: str) -> None:
    """One document with schema version 1; the rows are bounded by the export limit of ``regression_examples``."""
    document = examples.agg(
        F.array_sort(F.collect_list(F.struct("review_id", "extractor", "expected", "verdict", "text", "body_sha256", "reason"))).alias("examples")
    ).select(F.lit(1).alias("schema_version"), "examples")
    document.write.mode("overwrite").json(path)


def write_host_packs(packs: DataFrame, path: str) -> None:
    """One folder of JSON lines per pack."""
    packs.write.mode("overwrite").partitionBy("pack").json(path)


def append_outbox(rows: DataFrame, path: str) -> None:
    """Delivery payloads for an outside sender; nothing is sent from here."""
    rows.write.mode("append").parquet(path)
