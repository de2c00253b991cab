import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidelog.llm import token_files
from tidelog.llm.byte_bpe import decode, encode, round_trip_digests
from tidelog.llm.token_files import PerfectHash, ShardReader, key_hashes, read_documents, tokenized_documents, write_shard, write_token_files
from tidelog.session import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Hello  world\n\n it's 3 o'clock"), (2, None), (3, ""), (4, "a" * 4000), (5, "ab" * 500), (6, "é" * 300 + " ß"), (7, " \n\t x   "),
    (8, "日本語" * 50), (9, "<|endoftext|> x<|startoftext|>y"), (9, "second row of nine"), (None, "no id"), (11, "x y z\x1cq\x85w"), (12, "Å é ́x"), (13, "İstanbul ΣΑΣ ς"),
]


def texts(seed, count):
    rng = random.Random(seed)
    signs = "abetionhs    \n.,'!#0123456789éßñ日🙂"
    return [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 400)))) for i in range(count)]


@pytest.fixture
def tables(spark):
    rows = ODD + texts(5, 120)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_byte_bpe_equals_the_library(spark, tables):
    rows, df = tables
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_encode_and_decode_keep_columns(spark):
    df = spark.createDataFrame([(1, "ab ab", "z", [9]), (2, None, None, None)], "doc_id long, text string, row string, ids array<int>")
    out = decode(encode(df, RANKS, public_tokenizers.PATTERN), RANKS).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.row, bytes(r.decoded)) for r in out] == [(1, "ab ab", "z", b"ab ab"), (2, None, None, b"")]


def test_token_files_equal_the_library(spark, tables):
    rows, df = tables
    library = Tokenizer.from_file(WORDS)
    got = [tuple(r) for r in tokenized_documents(df, WORDS, 2).collect()]
    encoded = {}
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        encoded.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted((k, n, crc) for k, _, n, crc in got if k is not None) == sorted((k, n, crc) for k, v in encoded.items() if k is not None for n, crc in v)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert start == at
        at += n


def test_several_shards_repeated_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2500)
    rows = ODD + texts(8, 90) + [(9, f"copy {i % 3}") for i in range(150)] + [(None, "no id")] * 120 + [(200, "x " * 4000)]
    df = spark.createDataFrame([(k, t, "u", 5, 6) for k, t in rows], "doc_id long, text string, uri string, hash long, shard int").repartition(3)
    library = Tokenizer.from_file(WORDS)
    scratch = Scratch(spark)
    shards = write_token_files(df, WORDS, 2, scratch)
    held = {r.shard: r for r in shards.collect()}
    assert len(held) > 5 and sum(r.docs for r in held.values()) == len(rows)
    assert all(r.uri.startswith("file:/") for r in held.values())
    got = [tuple(r) for r in read_documents(shards).collect()]
    want = sorted((str(k), len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())) for k, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted((str(k), n, crc) for k, _, n, crc in got) == want
    at, last = 0, (False, 0)
    for key, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at and (key is not None, key or 0) >= last
        at, last = at + n, (key is not None, key or 0)
    reader = ShardReader(next(r.uri for r in held.values() if (200, 0) in [(k, 0) for k in ShardReader(r.uri)._section("key", "<i8").tolist()]))
    assert reader.get(200).tolist() == [*library.encode("x " * 4000, add_special_tokens=False).ids, 2]
    assert reader.get(201) is None or 201 in {k for k, _ in rows}


def test_paths_of_other_stores():
    assert token_files._filesystem("file:/a/b")[1] == token_files._filesystem("file:///a/b")[1] == "/a/b"
    assert token_files._filesystem("/a/b:c")[1] == "/a/b:c"
    with pytest.raises(pa.ArrowInvalid):
        token_files._filesystem("odd://store/a")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert tokenized_documents(empty, WORDS, 2).count() == 0


def test_perfect_hash_is_minimal_and_rejects_other_keys(spark):
    keys = np.random.default_rng(1).choice(10**12, 20_000, replace=False)
    none, valid = np.zeros(len(keys), dtype=np.uint32), np.ones(len(keys), dtype=bool)
    slots = PerfectHash.build(key_hashes(keys, none, valid)).slots(key_hashes(keys, none, valid))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    uri = Scratch(spark).root.removeprefix("file://") + ".bin"
    lengths = np.full(len(keys), 2)
    write_shard(uri, keys, valid, lengths, [np.arange(2 * len(keys)) % 60000], 2)
    reader = ShardReader(uri)
    assert reader.get(int(keys[77])).tolist() == [154, 155]
    others = np.setdiff1d(np.arange(10**6, 10**6 + 50_000), keys)
    found, _, _ = reader.find(others, np.zeros(len(others), dtype=np.uint32), np.ones(len(others), dtype=bool))
    assert found.sum() <= 2
