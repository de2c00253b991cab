"""Byte-level BPE over rank files: length-bucketed padded matrices in numpy inside Arrow tasks, and exact decoding.

A batch of texts is cut by the split pattern; pieces not met before in the task go to matrices of one row a piece, in buckets
of similar length.  Every round looks up the ranks of all neighbouring pairs in an open-addressing hash table and merges the
leftmost pair of minimum rank in every row that has one, then closes the gap; rows that are finished leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(0x7FFFFFFF)
# Longer pieces (rare runs without a break) take a heap instead of a matrix row, which would cost the square of their length.
LONGEST_ROW = 128
CACHED_PIECES = 250_000
ROW_CELLS = 1 << 20


class PairTable:
    """Ranks of mergeable pairs ``(left id, right id) -> merged id`` in open addressing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        left = np.fromiter((k[0] for k in pairs), dtype=np.int64, count=len(pairs))
        right = np.fromiter((k[1] for k in pairs), dtype=np.int64, count=len(pairs))
        keys, values = left << 32 | right, np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slot, waiting, self.reach = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):
            self.reach += 1
            free = waiting[self.keys[slot[waiting]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = (self.keys[slot] != keys) & (self.keys[slot] != -1)
        for _ in range(self.reach):
            rows = np.nonzero(open_)
            if not len(rows[0]):
                break
            slot[rows] = (slot[rows] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rows]]
            hit = found == keys[rows]
            out[rows] = np.where(hit, self.values[slot[rows]], out[rows])
            open_[rows] = ~hit & (found != -1)
        return out


class Vocabulary:
    """A rank file: token bytes by id, the ids of single bytes and the pair table."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = pairs
        self.table = PairTable(pairs)
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts, self.lengths = np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, all pieces of a length bucket at once."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(pieces)
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(sizes > LONGEST_ROW).tolist():
            out[i] = self._encode_long(pieces[i])
        low = 0
        for width in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, LONGEST_ROW):
            bucket = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, ROW_CELLS // width)
            for at in range(0, len(bucket), step):
                rows = bucket[at : at + step]
                self._merge_rows([pieces[i] for i in rows.tolist()], sizes[rows], width, rows, out)
        return out

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, width: int, names: np.ndarray, out: list[np.ndarray]) -> None:
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        ids, left = self.single[padded], sizes.copy()
        column = np.arange(width)
        while True:
            ranks = np.full((len(ids), max(width - 1, 1)), NONE, dtype=np.int32)
            if width > 1:
                ranks = np.where(column[None, 1:] < left[:, None], self.table.ranks(ids[:, :-1], ids[:, 1:]), NONE)
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(ids)), at]
            done = best == NONE
            if done.any():
                for row in np.flatnonzero(done).tolist():
                    out[names[row]] = ids[row, : left[row]].copy()
                ids, left, names, at, best = ids[~done], left[~done], names[~done], at[~done], best[~done]
                if not len(ids):
                    return
            # Write the merged id over its left part and move everything behind its right part one place forward.
            source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[np.arange(len(ids)), at] = best
            left = left - 1

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """One long piece: a heap of pairs over a linked list, in the same order of merges."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(size - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else size
            if j >= size or ids[j] != b or ids[i] != a:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < size and (r := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``: one gather over the concatenated token bytes."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[np.arange(len(shift)) + shift].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts and remembers the ids of pieces it has met, up to ``CACHED_PIECES``."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.number) > CACHED_PIECES:
            self._clear()
        split = [self.pattern.findall(t) if t else [] for t in texts]
        number = self.number
        fresh: list[str] = []
        for pieces in split:
            for piece in set(pieces):
                if piece not in number:
                    number[piece] = len(number)
                    fresh.append(piece)
        if fresh:
            found = self.vocabulary.encode_pieces([p.encode("utf-8") for p in fresh])
            sizes = np.fromiter((len(x) for x in found), dtype=np.int64, count=len(found))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, *found))
        for pieces in split:
            which = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            sizes = self.sizes[which]
            shift = np.repeat(self.starts[which] - (np.cumsum(sizes) - sizes), sizes)
            yield self.flat[np.arange(len(shift)) + shift]


def _slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of about ``size`` letters with their first rows; only one run is a Python list at a time."""
    at, part, total = 0, [], 0
    for row, text in enumerate(column):
        part.append(text.as_py())
        total += len(part[-1] or "")
        if total >= size:
            yield at, part
            at, part, total = row + 1, [], 0
    if part:
        yield at, part


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>): the token ids of every text; a null or empty text has none.

    The ids are those of the rank file at ``path`` (readable by every executor) with every match of ``pattern`` encoded on its
    own, without special tokens.  Rows stay as they are, repeated ones too; ``ids_col`` replaces a column of that name.
    """
    kept = [c for c in docs.columns if c != ids_col]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for at, part in _slices(batch.column(1)):
                found = list(encoder.encode(part))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), ids], ["row", "ids"])

    kind = docs.schema["row"].dataType.simpleString()
    out = docs.mapInArrow(run, f"row {kind}, ids array<int>")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` (binary): the bytes of the ids; null or empty ids give empty bytes."""
    kept = [c for c in encoded.columns if c != bytes_col]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            blobs = [words.decode(np.zeros(0, dtype=np.int64) if x is None else x.to_numpy(zero_copy_only=False).astype(np.int64)) for x in (v.values if v.is_valid else None for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["row", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, decoded binary")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], F.col("decoded").alias(bytes_col))


def encode_checked(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns with ``n_tokens``, ``ids`` and ``text_sha256``, the digest of the bytes that the ids decode to.

    Encoding and decoding share one pass, so a task runs one Python worker and the text does not come back from it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for at, part in _slices(batch.column(1)):
                found = list(encoder.encode(part))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                digests = [hashlib.sha256(encoder.vocabulary.decode(x)).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), ids, pa.array(digests)], ["row", "ids", "text_sha256"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, ids array<int>, text_sha256 string")
    return out.select(*[F.col(f"row.`{c}`") for c in carry], F.size("ids").alias("n_tokens"), "ids", "text_sha256")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row: ids hashed as little-endian uint32, decoded bytes hashed."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for at, part in _slices(batch.column(1)):
                sizes, ids_hash, text_hash = [], [], []
                for ids in encoder.encode(part):
                    sizes.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(encoder.vocabulary.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
