"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of ``documents``.
Quality rules drop texts, the n-gram Jaccard join keeps one document of each group, decontamination drops texts that hold
benchmark items, the secret scan masks secrets, and byte-level BPE turns the texts into checked token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.byte_bpe import encode_checked
from tidelog.llm.decontaminate import contained_items
from tidelog.llm.ngram_join import jaccard_components
from tidelog.llm.quality_rules import keep_good
from tidelog.llm.secret_scan import redact
from tidelog.session import Scratch


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many marks as it takes to be no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the place of every row of a stored table, file and row in it: the same in every scan, however the files are split."""
    names = [_free(docs, "_file"), _free(docs, "_at")]
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    Null, empty and short texts fail the base rules; repeated rows are judged alike and all kept; an empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies.

    Documents without words (null and empty texts too) are groups of their own.  Of repeated rows one stays; a row without an id stays
    only where its group has no id at all.  ``docs`` must be read from stored files; an empty table stays empty.
    """
    placed, place = _placed(docs)
    groups = jaccard_components(placed.select(*place, "doc_id", "text"), carry=tuple(place))
    alone = groups.filter("n_shingles = 0").select(*place)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *place))
    kept = groups.filter("n_shingles > 0").groupBy("component_key").agg(first.alias("first")).select(*(f"first.{c}" for c in place))
    # Kept rows are as many as the result; both sides are spread by the place.
    return placed.join(kept.unionByName(alone), place, "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and short texts hold none unless they are an item as a whole; repeated rows go or stay together, and rows without an id
    by their text; an empty table stays empty.
    """
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = Scratch(spark).cut(found.select("doc_id", "text_key").distinct())
    key = _free(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed[key] == found["text_key"])
    return keyed.join(found, same, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; ``n_chars`` follows the text.

    Null and empty texts and texts without a secret stay as they are, repeated rows alike; an empty table stays empty.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, text_sha256)``: ids as they are in the rank file, digest of the decoded bytes.

    A null or empty text has no ids; repeated rows and rows without an id give a row each; an empty table stays empty.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_checked(docs, path, public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("byte-level BPE", token_ids),
]

# The learned stages cannot be put in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a table in the shared folder between two stages."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.cut(docs, "stage")
    return docs
