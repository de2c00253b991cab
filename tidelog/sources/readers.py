"""Readers: captures, gate rules, known-bad hashes, source packs and reviewed examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import top_rows
from ..schemas import CAPTURES, REVIEWED_EXAMPLES, SOURCE_PACK


def read_captures(spark: SparkSession, path: str, schema: str = CAPTURES) -> DataFrame:
    """Stored captures; column pruning and filters reach the files."""
    return spark.read.schema(schema).parquet(path)


def stream_captures(spark: SparkSession, path: str, schema: str = CAPTURES, files_per_trigger: int = 1000) -> DataFrame:
    """The capture log as a stream of newly arriving files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(position, category, pattern)`` from lines ``category: regex``; blank lines and ``#`` comments are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    trimmed = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains(":"))
    parts = F.split("line", ":", 2)
    return trimmed.select("position", F.trim(parts[0]).alias("category"), F.trim(parts[1]).alias("pattern"))


def read_known_bad(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case hashes: the first token of every line that is no comment."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return kept.select(F.split("line", r"\s+")[0].alias("sha256")).distinct()


def _packs_in(spark: SparkSession, folder: str, origin: str, priority: int) -> DataFrame:
    raw = (
        spark.read.schema(SOURCE_PACK + ", _corrupt STRING")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(f"{folder.rstrip('/')}/*.json")
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    usable = F.filter(F.coalesce("sources", F.expr("cast(array() as array<struct<url: string, note: string, last_seen: string, evidence: string>>)")), lambda s: F.coalesce(s["url"] != "", F.lit(False)))
    return (
        raw.select("*", stem.alias("_stem"))
        .filter(F.col("_corrupt").isNull())
        .select(
            F.when(F.col("name") != "", F.col("name")).otherwise(F.col("_stem")).alias("name"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("category", F.lit("other")).alias("category"),
            F.coalesce("version", F.lit("unknown")).alias("version"),
            usable.alias("sources"),
            F.lit(origin).alias("origin"),
            F.lit(priority).alias("_priority"),
            "_stem",
        )
        .withColumn("name", F.coalesce("name", "_stem"))
    )


def read_source_packs(spark: SparkSession, bundled: str | None, operator: str | None = None) -> DataFrame:
    """Source packs, one per name: the operator's copy wins, then the later file.  Unreadable files are skipped."""
    parts = [_packs_in(spark, folder, origin, rank) for rank, (folder, origin) in enumerate(((bundled, "bundled"), (operator, "operator"))) if folder]
    if not parts:
        raise ValueError("give at least one pack folder")
    packs = parts[0]
    for part in parts[1:]:
        packs = packs.unionByName(part)
    best = top_rows(packs, ["name"], [F.desc("_priority"), F.desc("_stem")], 1)
    return best.drop("_priority", "_stem", "_rank").orderBy("category", "name")


def pack_sources(packs: DataFrame) -> DataFrame:
    """One row per source of every pack."""
    return packs.select("name", "category", "origin", F.explode("sources").alias("s")).select("name", "category", "origin", "s.*")


def read_reviewed_examples(spark: SparkSession, path: str) -> DataFrame:
    """Exported review examples; any schema version but 1 is refused when rows are read."""
    raw = spark.read.schema(REVIEWED_EXAMPLES).option("multiLine", True).json(path)
    version = F.when(F.col("schema_version") == 1, F.col("schema_version")).otherwise(F.raise_error(F.lit("examples of another schema version than 1")))
    return raw.select(version.alias("_v"), F.explode("examples").alias("e")).filter(F.col("_v") == 1).select("e.*")
