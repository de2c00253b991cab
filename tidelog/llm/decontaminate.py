"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Jaccard similarity of a short item and a long document is tiny even when the document holds the whole item.  Two steps keep
MinHash useful.  First a document's shingle set is cut down to shingles that some item has (a Bloom filter of the item
shingles, of fixed size): that changes no containment, and a clean document keeps next to nothing.  Then documents are
partitioned by the size of what is left; for every pair of a document size class and an item size class the containment
threshold becomes a Jaccard threshold, from the upper bound of the one and the lower bound of the other, which gives the number
of MinHash values needed to miss a pair with probability of at most ``MISS``.  Class pairs that would need more than
``MAX_HASHES`` values post every remaining shingle instead, which misses nothing.  All candidates are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .shingles import mix, shingle_sets

MISS = 1e-7
MAX_HASHES = 256
# One block of items fills a filter of 2**FILTER_BITS bits (2 MB) to ten bits a shingle; more items take more blocks.
FILTER_BITS = 24
BLOCK_SHINGLES = (1 << FILTER_BITS) // 10


def _probes(tokens: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - FILTER_BITS)
    return [mix(tokens ^ np.uint64(salt)) >> shift for salt in (0xA5A5, 0x5A5A5A, 0xC3C3C3C3, 0x3C3C)]


def _hits(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    left = tokens
    for i in range(4):
        at = _probes(left)[i]
        left = left[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def _item_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "n", "tokens"]
            )

    return run


def _restricted(words: int, shared):
    """Documents with at least one shingle of an item: ``(doc_id, text_key, n, tokens)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, sizes, blobs = [], [], []
            for i, tokens in enumerate(shingle_sets(batch.column(2), words)):
                left = _hits(tokens, bits)
                if len(left):
                    rows.append(i)
                    sizes.append(len(left))
                    blobs.append(left.tobytes())
            found = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "text_key", "n", "tokens"])

    return run


def hashes_needed(doc_class: int, item_class: int, percent: int) -> int:
    """MinHash values for documents of up to ``2**(doc_class+1)`` and items of at least ``2**item_class`` shingles; 0: post all."""
    q, u = 2.0**item_class, 2.0 ** (doc_class + 1)
    common = percent / 100 * q
    jaccard = min(0.99, common / max(u + q - common, q))
    count = math.ceil(math.log(MISS) / math.log1p(-jaccard))
    return count if count <= MAX_HASHES else 0


def _class(n: int) -> int:
    return int(n).bit_length() - 1


def _keys(percent: int, items: bool, classes: tuple[int, ...]):
    """``(row, key)``: the join keys of each set for every class of the other side that could match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                own = _class(len(tokens))
                for other in classes:
                    doc, item = (other, own) if items else (own, other)
                    # A containment of the threshold needs |document| >= threshold * |item|.
                    if 2 ** (doc + 1) * 100 <= percent * 2**item:
                        continue
                    pair = np.uint64(doc * 64 + item + 1)
                    count = hashes_needed(doc, item, percent)
                    salt = mix(np.arange(count, dtype=np.uint64) * np.uint64(8192) + pair)
                    if count:
                        lows = np.concatenate([mix(tokens[None, :] ^ salt[at : at + 32, None]).min(axis=1) for at in range(0, count, 32)])
                        found = mix(lows + salt)
                    else:
                        found = mix(tokens + pair)
                    keys.append(found)
                    rows.append(np.full(len(found), row, dtype=np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys).view(np.int64))], ["row", "key"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [len(np.intersect1d(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64), assume_unique=True)) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int32())], ["doc_id", "text_key", "item_id", "n_item", "n_shared"])


def _search_block(docs: DataFrame, items: DataFrame, words: int, percent: int, scratch: Scratch, block: int) -> DataFrame:
    spark = docs.sparkSession
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in items.select("tokens").toLocalIterator():
        tokens = np.frombuffer(row["tokens"], dtype=np.uint64)
        for at in _probes(tokens):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bits)
    left = docs.mapInArrow(_restricted(words, shared), "doc_id long, text_key long, n int, tokens binary")
    left = scratch.cut(left.withColumn("row", F.monotonically_increasing_id()), f"restricted-{block}")
    doc_classes = tuple(r[0] for r in left.select(F.floor(F.log2("n") + 1e-9).cast("int")).distinct().collect())
    item_classes = tuple(r[0] for r in items.select(F.floor(F.log2("n") + 1e-9).cast("int")).distinct().collect())
    doc_keys = left.select("row", "tokens").mapInArrow(_keys(percent, False, item_classes), "row long, key long")
    item_keys = items.select(F.col("item_row").alias("row"), "tokens").mapInArrow(_keys(percent, True, doc_classes), "row long, key long").select(F.col("row").alias("item_row"), "key")
    pairs = scratch.cut(doc_keys.join(item_keys, "key").select("row", "item_row").distinct(), f"pairs-{block}")
    full = pairs.join(left, "row").select("doc_id", "text_key", "item_row", F.col("tokens").alias("a"))
    full = full.join(items.select("item_row", "item_id", F.col("n").alias("n_item"), F.col("tokens").alias("b")), "item_row")
    full = full.select("doc_id", "text_key", "item_id", "n_item", "a", "b")
    return full.mapInArrow(_overlap, "doc_id long, text_key long, item_id long, n_item int, n_shared int").filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, text_key, item_id, n_item, n_shared)`` for each item of which a document holds ``percent`` of the shingles.

    ``text_key`` is the xxhash64 of the text, to find the row again where ids repeat.  A text of fewer than ``words`` words is
    one shingle, its whole sequence; a null or word-free text or item matches nothing.  Repeated rows give repeated results.
    An empty table on either side gives no rows.  Items are taken in blocks of ``BLOCK_SHINGLES`` shingles, each with one scan
    of the documents, so that nothing that is broadcast grows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, keep=1 << 30)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(_item_sets(words), "item_id long, n int, tokens binary")
    items = scratch.cut(items.filter("n > 0").withColumn("item_row", F.monotonically_increasing_id()), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    count = -(-total // BLOCK_SHINGLES)
    found = spark.createDataFrame([], "doc_id long, text_key long, item_id long, n_item int, n_shared int")
    for block in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_row"), F.lit(count)) == block) if count > 1 else items
        found = found.unionByName(_search_block(docs, part, words, percent, scratch, block))
    return found
