"""Documents as token ids, cut into pieces and packed into sequences of one length.

One pass writes the pieces with their ids.  Within its task every piece is numbered among the pieces of its length; the counts per
(task, length) - narrow rows - give each piece its rank among all pieces of its length, without bringing a length into one task.  The
histogram of lengths, ``capacity`` rows whatever the size of the corpus, is packed by ``bin_completion``; a piece finds its sequence
from its length and rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .bin_completion import Packing, pack_lengths
from .unit_ids import byte_level_ids, tokenizer

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, task int, nth long"
BATCH_BYTES = 8 << 20


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only above ``capacity``, where the first piece takes the remainder.

    ``ids`` are little-endian unsigned integers of two bytes, or of four if the vocabulary needs them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level_ids(tokenizer_path)
        largest = max(end_id, tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1)
        kind = "<u2" if largest < 1 << 16 else "<u4"
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        held: list[list] = [[] for _ in range(8)]
        size = 0

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
            for column in held:
                column.clear()
            return batch

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, sizes in coder.encode(batch.column(1)):
                at = np.concatenate(([0], np.cumsum(sizes)))
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], end_id)
                    low = 0
                    high = (len(whole) - 1) % capacity + 1
                    piece = 0
                    while low < len(whole):
                        part = whole[low:high]
                        n = len(part)
                        payload = part.astype(kind).tobytes()
                        row = (keys[first + i], piece, low, n, zlib.crc32(part.astype("<u4").tobytes()), payload, task, int(seen[n]))
                        for column, value in zip(held, row, strict=True):
                            column.append(value)
                        seen[n] += 1
                        size += len(payload) + 64
                        piece, low, high = piece + 1, high, high + capacity
                    if size > BATCH_BYTES:
                        yield flush()
                        size = 0
        if held[0]:
            yield flush()

    return rows.mapInArrow(run, PIECES)


def _slots(plan: Packing, capacity: int) -> dict[int, np.ndarray]:
    """For every length rows ``(first rank, first sequence, copies in a sequence, offset of the first copy)`` by rising rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = [0] * (capacity + 1)
    sequence = 0
    for filling, times in plan.fillings:
        offset = 0
        for length, count in filling:
            rows.setdefault(length, []).append((ranks[length], sequence, count, offset))
            ranks[length] += count * times
            offset += count * length
        sequence += times
    return {length: np.array(found, dtype=np.int64) for length, found in rows.items()}


def _place(ranked: DataFrame, slots: dict[int, np.ndarray]) -> DataFrame:
    kept = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[group[0]])
                rows = slots[n]
                row = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
                nth = rank[group] - row[:, 0]
                sequence[group] = row[:, 1] + nth // row[:, 2]
                offset[group] = row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Packing]:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` of every piece, and the packing of lengths.

    A null or empty text is the end id alone; rows with equal or null ids are documents of their own; other columns are ignored; an
    empty table gives no rows.  Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    pieces = Scratch(docs.sparkSession).cut(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row.length] = row.n
    plan = pack_lengths(counts, capacity)
    # One row per task and length: the window of a length holds as many rows as there are tasks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ranked = pieces.join(base, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).select(*columns, (F.col("_base") + F.col("nth")).alias("rank"))
    return _place(ranked, _slots(plan, capacity)), plan
