"""Token ids of texts from the ids of their units, for tokenizers that never join tokens across the units' borders.

A unit is a word, with or without the white space before it.  The units of a block are found with numpy, looked up in a table
that compares their bytes, and only those not met before go to the tokenizers library, many in one call.  The table has a fixed
size; a unit that loses its place is encoded again when it comes back, so memory does not follow the vocabulary and results
never depend on what the table holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .shingles import _SPACE, blocks, mix, text_bytes

BLOCK_BYTES = 1 << 21
SLOT_BITS = 21
POOL_IDS = 8_000_000
# Units up to here are held as two 64-bit words in the table; longer ones (one in six hundred) in a dictionary.
SHORT = 16
LONG_UNITS = 20_000
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_FULL = np.concatenate((_MASK, np.full(SHORT - 8, _MASK[8])))


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without ASCII white space; none crosses a cut."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[cuts] = True
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def space_borders(data: np.ndarray) -> np.ndarray:
    """Places where ASCII white space follows a character that is no white space of any kind.

    Split patterns in which white space only starts a piece, or is one, never reach across such a place.
    """
    space = _SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if not len(wide):
        return at
    last = data[at[wide] - 1]
    second = data[np.maximum(at[wide] - 2, 0)]
    third = data[np.maximum(at[wide] - 3, 0)]
    # White_Space beyond ASCII: U+0085 A0 1680 2000-200A 2028 2029 202F 205F 3000.
    blank = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    blank |= (third == 0xE1) & (second == 0x9A) & (last == 0x80)
    blank |= (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    blank |= (third == 0xE2) & (second == 0x81) & (last == 0x9F)
    blank |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
    return np.delete(at, wide[blank])


def spaced_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the white space before them, and white space at the end of a text: all bytes belong to a unit."""
    edge = np.zeros(len(data), dtype=bool)
    edge[space_borders(data)] = True
    edge[cuts[:-1][np.diff(cuts) > 0]] = True
    starts = np.flatnonzero(edge)
    return starts, np.append(starts[1:], len(data))[: len(starts)]


class UnitTable:
    """Ids of units met before: one place a unit, found by hash, taken only if the unit's bytes are the same."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        size = 1 << SLOT_BITS
        self.head, self.tail = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.bytes = np.zeros(size, dtype=np.uint8)
        self.place, self.size = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _store(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode ``units`` into the pool; returns their places and sizes there."""
        ids, sizes = self.learn(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return places, sizes

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each has."""
        if self.used > POOL_IDS or len(self.long) > LONG_UNITS:
            self._clear()
        sizes = ends - starts
        places, counts = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        if len(short):
            places[short], counts[short] = self._short(data, starts[short], sizes[short])
        rest = np.flatnonzero(sizes > SHORT)
        if len(rest):
            units = [data[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            fresh = [u for u in dict.fromkeys(units) if u not in self.long]
            if fresh:
                at, n = self._store(fresh)
                self.long.update(zip(fresh, zip(at.tolist(), n.tolist(), strict=True), strict=True))
            places[rest], counts[rest] = np.array([self.long[u] for u in units], dtype=np.int64).T
        shift = np.repeat(places - (np.cumsum(counts) - counts), counts)
        return self.pool[np.arange(len(shift)) + shift], counts

    def _short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
        head = eights[starts].view("<u8").ravel() & _FULL[sizes]
        tail = np.zeros(len(starts), dtype=np.uint64)
        wide = np.flatnonzero(sizes > 8)
        tail[wide] = eights[starts[wide] + sizes[wide] - 8].view("<u8").ravel()
        slot = (mix(head ^ mix(tail + sizes.astype(np.uint64))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = (self.head[slot] == head) & (self.tail[slot] == tail) & (self.bytes[slot] == sizes)
        places, counts = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if len(missed):
            order = missed[np.lexsort((sizes[missed], tail[missed], head[missed]))]
            other = (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
            first = np.concatenate(([True], other))
            chosen = order[first]
            raw = data.tobytes()
            at, n = self._store([raw[a : a + s] for a, s in zip(starts[chosen].tolist(), sizes[chosen].tolist(), strict=True)])
            which = np.cumsum(first) - 1
            places[order], counts[order] = at[which], n[which]
            to = slot[chosen]
            # Where two fresh units want one place numpy keeps the last of them in every array.
            self.head[to], self.tail[to], self.bytes[to], self.place[to], self.size[to] = head[chosen], tail[chosen], sizes[chosen], at, n
        return places, counts


def _spans(raw: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Cut a long text at borders of units into parts of about ``BLOCK_BYTES``; a part without a border grows until it has one."""
    while high - low > BLOCK_BYTES:
        size = BLOCK_BYTES
        while True:
            if high - low <= size:
                end = high
                break
            found = space_borders(raw[low : low + size])
            if len(found):
                end = low + int(found[-1])
                break
            size *= 2
        yield low, end
        low = end
    if high > low:
        yield low, high


class TextIds:
    """Ids of whole texts of an Arrow column."""

    def __init__(self, split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.split, self.table = split, UnitTable(learn)

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.split(data, cuts)
        ids, counts = self.table.ids(data, starts, ends)
        upto = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(upto[np.searchsorted(starts, cuts)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows: the first row, all ids of the run, and the number of ids of each row.  Null is empty."""
        raw, bounds = text_bytes(column)
        for first, last in blocks(bounds, BLOCK_BYTES):
            low, high = int(bounds[first]), int(bounds[last])
            if last == first + 1 and high - low > BLOCK_BYTES:
                ids = np.concatenate([self._block(raw[a:b], np.array([0, b - a]))[0] for a, b in _spans(raw, low, high)])
                yield first, ids, np.array([len(ids)])
            else:
                ids, sizes = self._block(raw[low:high], bounds[first : last + 1] - low)
                yield first, ids, sizes


# ---------------------------------------------------------------- tokenizers of the library


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _learn_lines(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """For tokenizers that drop white space: a unit a line, told apart by the offsets of their tokens."""

    def learn(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(units), 4096):
            lines = [u.decode("utf-8", "replace") for u in units[at : at + 4096]]
            found = tokenizer(path).encode("\n".join(lines), add_special_tokens=False)
            begins = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
            place = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found))
            line = np.searchsorted(begins, place, side="right") - 1
            ids.append(np.array(found.ids, dtype=np.int32))
            sizes.append(np.bincount(line, minlength=len(lines)))
        return np.concatenate(ids), np.concatenate(sizes)

    return learn


# The split pattern of the byte-level tokenizers, a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below U+0500 (lead bytes up to D3) the regex engines of both libraries agree on letters and digits; newer characters may differ.
SETTLED = 0xD4


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level tokenizer file, if its ids are the ranks of its merges; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    parts = model["pre_tokenizer"] or {}
    if model["normalizer"] or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True) or model["model"].get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocabulary = model["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [vocabulary["".join(pair)] for pair in merges]
    single = max(ranks[bytes([b])] for b in range(256))
    return ranks if made == sorted(made) and made[0] > single and len(set(made)) == len(made) else None


def _learn_byte_level(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Units of settled characters by the ranks of the file, the others, and those with an added token, by the library."""
    import tiktoken

    own, ranks = tokenizer(path), _ranks(path)
    added = [t.content.encode() for t in own.get_added_tokens_decoder().values()]
    special = {c.decode(): i for i, c in enumerate(added, 1 << 24)}
    fast = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks={k: v for k, v in ranks.items() if k not in added}, special_tokens=special) if ranks else None

    def learn(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(units)
        plain = [i for i, u in enumerate(units) if max(u) < SETTLED and not any(c in u for c in added)] if fast else []
        for i in plain:
            found[i] = fast.encode_ordinary(units[i].decode())
        rest = [i for i, x in enumerate(found) if x is None]
        for i, encoding in zip(rest, own.encode_batch([units[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            found[i] = encoding.ids
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), sizes

    return learn


@lru_cache(maxsize=1)
def word_ids(path: str) -> TextIds:
    """For a tokenizer that drops white space and never joins across it; kept by the Python worker from task to task."""
    return TextIds(words, _learn_lines(path))


@lru_cache(maxsize=1)
def byte_level_ids(path: str) -> TextIds:
    """For a byte-level tokenizer whose pieces take white space only at their start; kept by the Python worker."""
    return TextIds(spaced_words, _learn_byte_level(path))
