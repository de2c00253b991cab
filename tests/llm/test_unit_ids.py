import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import unit_ids
from tidelog.llm.unit_ids import byte_level_ids, word_ids

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = "abetionhsABE      \n\t\r\x0b\x0c.,'!#0123456789éßñ日🙂\x85\xa0      　​\x1c<>|"
ODD = [None, "", " ", "\n\n", "a", "  a  ", "<|endoftext|>", " x<|endoftext|> y <|startoftext|>", "it's I'LL  we've", "日" * 300, "　 a", "a   b", "a 　　  b\xa0 ", "A" * 5000, "é" * 17 + " " + "é" * 8]


def some_texts(seed, count, size=120):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, size))) for _ in range(count)]


def encoded(coder, texts):
    out = []
    for first, ids, sizes in coder.encode(pa.array(texts, pa.string())):
        assert first == len(out)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


@pytest.mark.parametrize("path, coder", [(BYTES, byte_level_ids), (WORDS, word_ids)])
def test_equals_the_library(path, coder):
    texts = some_texts(3, 4000)
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(coder(path), texts) == want
    assert encoded(coder(path), texts[::-1]) == want[::-1]


@pytest.mark.parametrize("path, coder", [(BYTES, byte_level_ids), (WORDS, word_ids)])
def test_a_crowded_table_and_small_blocks_change_nothing(monkeypatch, path, coder):
    monkeypatch.setattr(unit_ids, "SLOT_BITS", 4)
    monkeypatch.setattr(unit_ids, "BLOCK_BYTES", 300)
    monkeypatch.setattr(unit_ids, "POOL_IDS", 500)
    monkeypatch.setattr(unit_ids, "LONG_UNITS", 3)
    texts = some_texts(8, 300, 900)
    library = Tokenizer.from_file(path)
    coder.cache_clear()
    try:
        assert encoded(coder(path), texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    finally:
        coder.cache_clear()


def test_both_libraries_agree_on_settled_characters():
    """Every character that the ranks are trusted with, between letters, digits, signs and blanks."""
    library, learn = Tokenizer.from_file(BYTES), unit_ids._learn_byte_level(BYTES)
    units = [u for c in range(1, 0x500) for u in (f" a{chr(c)}b", f"1{chr(c)}2", f"!{chr(c)}{chr(c)}?", f" {chr(c)}", f"'{chr(c)}s")]
    units = [u for u in units if max(u.encode()) < unit_ids.SETTLED]
    ids, sizes = learn([u.encode() for u in units])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in library.encode_batch(units, add_special_tokens=False)]
