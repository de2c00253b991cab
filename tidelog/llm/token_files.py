"""Token-id shard files with a minimal perfect hash index, written and read by Spark tasks.

Documents are range-partitioned in id order; each partition becomes one file.  File layout, little-endian:

    magic ``TIDX0001`` | u64 header length | JSON header | sections named in the header, each padded to 8 bytes

Sections: ``bits`` (the levels of the hash, one after the other), ``finger`` u32, ``start`` u64 and ``length`` u64 by hash slot,
``key`` i64, ``nth`` u32 and ``valid`` u8 in document order, ``payload`` (ids as u16 or u32, documents end to end).

A key is the document id and its occurrence number (0 unless an id repeats within a shard).  The hash has one bit array per
level: keys whose bit nobody else wants on a level stay there, the others go on; the slot is the rank of the bit.  A stored
32-bit fingerprint rejects keys that are not in the shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .shingles import mix
from .unit_ids import tokenizer, word_ids

MAGIC = b"TIDX0001"
SHARD_BYTES = 32 << 20
LOAD = 1.5
LEVELS = 48


# ---------------------------------------------------------------- minimal perfect hash


def key_hashes(keys: np.ndarray, nth: np.ndarray, valid: np.ndarray) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    h = np.where(valid.astype(bool), h, np.uint64(0x1F83D9ABFB41BD6B))
    return mix(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    sizes: list[int]
    bits: np.ndarray  # uint8 of 0/1, the levels one after the other
    ranks: np.ndarray  # ones before each position

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes`` must be distinct."""
        sizes, levels, left, level = [], [], hashes, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("keys repeat")
            size = max(64, int(len(left) * LOAD))
            at = _place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone.astype(np.uint8))
            left, level = left[~alone[at]], level + 1
        return cls.of(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint8))

    @classmethod
    def of(cls, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        return cls(sizes, bits, np.concatenate(([0], np.cumsum(bits, dtype=np.int64))))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key in constant expected time; -1 where no level has its bit."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(hashes[left], level, size)
            hit = self.bits[at] == 1
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return out


# ---------------------------------------------------------------- files


# Schemes that Hadoop and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme; one without is the machine's own disk."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{'/' if scheme == 'file' else ''}{rest.lstrip('/')}")


def _shared_folder(spark: SparkSession, folder: str) -> str:
    """Make ``folder`` and name it with its scheme, as Spark resolves it, so that tasks on any machine write to the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    qualified = files.makeQualified(path).toString()
    _filesystem(qualified)  # a scheme that Arrow does not know fails here, before any work
    return qualified


def _finger(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)


def write_shard(uri: str, keys: np.ndarray, valid: np.ndarray, lengths: np.ndarray, payload: list[np.ndarray], width: int) -> None:
    """Write one shard under a temporary name, then move it: a repeated or lost attempt leaves a whole file or none."""
    nth = np.zeros(len(keys), dtype=np.uint32)
    if len(keys):
        order = np.lexsort((keys, valid))
        k, v = keys[order], valid[order]
        first = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        nth[order] = (np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))).astype(np.uint32)
    hashes = key_hashes(keys, nth, valid)
    index = PerfectHash.build(hashes)
    slot = index.slots(hashes)
    starts = np.cumsum(lengths) - lengths
    finger, start, length = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    finger[slot], start[slot], length[slot] = _finger(hashes), starts, lengths
    bits = np.packbits(index.bits, bitorder="little")
    sections = {"bits": bits, "finger": finger, "start": start, "length": length, "key": keys.astype("<i8"), "nth": nth.astype("<u4"), "valid": valid.astype("u1")}
    tokens = int(lengths.sum())
    places, at = {}, 0
    for name, data in [*((n, d.nbytes) for n, d in sections.items()), ("payload", tokens * width)]:
        places[name] = [at, data]
        at += -(-data // 8) * 8
    header = json.dumps({"docs": len(keys), "tokens": tokens, "width": width, "levels": index.sizes, "bits": len(index.bits), "sections": places}).encode()
    header += b" " * (-(len(MAGIC) + 8 + len(header)) % 8)
    filesystem, path = _filesystem(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        out.write(MAGIC + len(header).to_bytes(8, "little") + header)
        for data in sections.values():
            out.write(data.tobytes() + b"\0" * (-data.nbytes % 8))
        for part in payload:
            out.write(part.astype(f"<u{width}").tobytes())
        out.write(b"\0" * (-tokens * width % 8))
    filesystem.move(temporary, path)


class ShardReader:
    """Random access to one shard: the index is read once, payloads by range."""

    def __init__(self, uri: str):
        filesystem, path = _filesystem(uri)
        self.file = filesystem.open_input_file(path)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        size = int.from_bytes(head[8:], "little")
        self.header = json.loads(self.file.read_at(size, 16))
        self.base, self.width = 16 + size, self.header["width"]
        bits = np.unpackbits(self._section("bits", "u1"), count=self.header["bits"], bitorder="little")
        self.index = PerfectHash.of(self.header["levels"], bits)
        self.finger, self.start, self.length = self._section("finger", "<u4"), self._section("start", "<u8"), self._section("length", "<u8")

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, size = self.header["sections"][name]
        return np.frombuffer(self.file.read_at(size, self.base + at), dtype=kind)

    def find(self, keys: np.ndarray, nth: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(found, start, length)`` of each key, through the hash and its fingerprint."""
        hashes = key_hashes(keys, nth, valid)
        slot = self.index.slots(hashes)
        found = slot >= 0
        found[found] = self.finger[slot[found]] == _finger(hashes[found])
        safe = np.where(found, slot, 0)
        zero = np.zeros(len(keys), dtype=np.int64)
        if not len(self.start):
            return found, zero, zero
        return found, np.where(found, self.start[safe].astype(np.int64), 0), np.where(found, self.length[safe].astype(np.int64), 0)

    def ids(self, start: int, length: int) -> np.ndarray:
        at = self.base + self.header["sections"]["payload"][0] + start * self.width
        return np.frombuffer(self.file.read_at(length * self.width, at), dtype=f"<u{self.width}")

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of one document, or None where the shard has no such key."""
        found, start, length = self.find(np.array([key or 0]), np.array([nth]), np.array([key is not None]))
        return self.ids(int(start[0]), int(length[0])) if found[0] else None


# ---------------------------------------------------------------- Spark jobs


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order, one file per range; returns ``(shard, uri, docs, tokens)`` of the files.

    Nulls come first, equal ids are ordered by a hash of the text.  A null or empty text is the end id alone.  Ranges are cut by id, text
    hash and a random number, so rows of one id, and copies of one text under it, may fill several files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    folder = _shared_folder(spark, f"{scratch.root}/token-files")
    order = F.asc_nulls_first("doc_id"), F.asc_nulls_first("hash")
    # Rows that only the random number tells apart are equal, so it does not matter which of them comes first.
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.rand(7).alias("any"))
    rows = keyed.repartitionByRange(shards, *order, "any").sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path)
        vocabulary = max(end_id, tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1)
        width = 2 if vocabulary < 1 << 16 else 4
        keys, valid, lengths, payload = [], [], [], []
        for batch in batches:
            valid.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            keys.append(batch.column(0).fill_null(0).to_numpy())
            for _, ids, sizes in coder.encode(batch.column(1)):
                whole = np.full(len(ids) + len(sizes), end_id, dtype=f"<u{width}")
                kept = np.ones(len(whole), dtype=bool)
                kept[np.cumsum(sizes + 1) - 1] = False
                whole[kept] = ids
                lengths.append(sizes + 1)
                payload.append(whole)
        shard = TaskContext.get().partitionId()
        if not keys:
            return
        uri = f"{folder}/shard-{shard:07d}.bin"
        sizes = np.concatenate(lengths).astype(np.int64)
        write_shard(uri, np.concatenate(keys), np.concatenate(valid), sizes, payload, width)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "docs": [len(sizes)], "tokens": [int(sizes.sum())]})

    return scratch.cut(rows.mapInArrow(run, "shard long, uri string, docs long, tokens long"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, each looked up by its key in its file.

    ``start`` counts the ids of all documents before it; the crc is over the ids as little-endian uint32.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per file
    based = shards.select("shard", "uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    spread = based.repartition(max(1, shards.count()), "shard").select("uri", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(uri)
                keys, nth, valid = reader._section("key", "<i8"), reader._section("nth", "<u4"), reader._section("valid", "u1")
                found, start, length = reader.find(keys, nth, valid)
                if not found.all():
                    raise ValueError(f"{uri}: the index misses keys")
                for at in range(0, len(keys), 1024):
                    part = slice(at, at + 1024)
                    low = int(start[part].min())
                    ids = reader.ids(low, int((start[part] + length[part]).max()) - low)
                    sums = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip((start[part] - low).tolist(), length[part].tolist(), strict=True)]
                    own = pa.array(keys[part].astype(np.int64), mask=valid[part] == 0)
                    yield pa.RecordBatch.from_arrays([own, pa.array(start[part] + base), pa.array(length[part]), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and read every document back by its key.

    One row per input row: repeated ids keep a row each (they are numbered within their shard), a null id comes first, other
    columns are ignored, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    return read_documents(write_token_files(docs, tokenizer_path, end_id, scratch, id_col, text_col))
