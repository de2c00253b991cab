"""Fill-in-middle transformation with cuts found through content-defined chunks.

Texts are cut into chunks where a rolling hash of the last ``WINDOW`` bytes says so, so copies and shared passages give the same
chunks wherever they stand.  A chunk is summarised once: words begun, whether it begins and ends inside a word, code points, and
whether it ends in white space.  Summaries are kept by the hash of the chunk and used again only after the bytes were compared.
Two neighbours combine by adding up, less one word where a word runs across their border; running totals therefore give the number
of tokens of a document and the one chunk in which a cut falls, and only that chunk is read again.

Tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a word with the white space before it, or white space at
the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _BASE, _BASE_INV, _SPACE, _power_tables, blocks, mix, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32
# A border where this many low bits of the window's hash are zero: chunks of about 1 KB.
BORDER_BITS = 10
LONGEST_CHUNK = 1 << 14
BLOCK_BYTES = 1 << 22
CACHE_BYTES = 64 << 20


@dataclass
class Summaries:
    """Of every chunk of a block, in order."""

    words: np.ndarray  # words begun in the chunk, its first byte counting as a beginning
    points: np.ndarray  # code points
    opens: np.ndarray  # begins inside or at a word
    closes: np.ndarray  # ends inside or at the end of a word


class ChunkCache:
    """Summaries of chunks met before in this worker, by hash, each with the bytes it was made from."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.known = limit, 0, {}
        self.hits = 0

    def summaries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Summaries:
        found = np.zeros((len(starts), 4), dtype=np.int64)
        fresh, first, same = [], {}, []
        view = memoryview(data)
        for i, (a, b, h) in enumerate(zip(starts.tolist(), ends.tolist(), hashes.tolist(), strict=True)):
            known = self.known.get(h)
            if known is not None and known[0] == view[a:b]:
                found[i] = known[1]
                self.hits += 1
            elif h in first and view[starts[first[h]] : ends[first[h]]] == view[a:b]:
                same.append(i)
            else:
                first.setdefault(h, i)
                fresh.append(i)
        if fresh:
            found[fresh] = made = summarise(data, starts[fresh], ends[fresh])
            for i, facts in zip(fresh, made.tolist(), strict=True):
                content = bytes(view[starts[i] : ends[i]])
                if self.held + len(content) > self.limit:
                    self.known.clear()
                    self.held = 0
                self.known[int(hashes[i])] = (content, facts)
                self.held += len(content)
            found[same] = found[[first[h] for h in hashes[same].tolist()]]
        return Summaries(found[:, 0], found[:, 1], found[:, 2] == 1, found[:, 3] == 1)


def summarise(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``(words, code points, opens, closes)`` of chunks that hold a byte each."""
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - heads, sizes)
    piece = data[at]
    inside = ~_SPACE[piece]
    before = np.concatenate(([False], inside[:-1]))
    before[heads] = False
    begun = np.add.reduceat((inside & ~before).astype(np.int64), heads)
    points = np.add.reduceat(((piece & 0xC0) != 0x80).astype(np.int64), heads)
    return np.stack([begun, points, inside[heads], inside[heads + sizes - 1]], axis=1).astype(np.int64)


def chunk_borders(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes)`` of the chunks of the texts between ``cuts``; no chunk crosses a text or splits a code point."""
    size = len(data)
    powers, inverse = _power_tables(size + 1)
    prefix = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:size], dtype=np.uint64, out=prefix[1:])
    ends = np.arange(min(WINDOW, size + 1), size + 1)
    rolling = mix((prefix[ends] - prefix[ends - WINDOW]) * inverse[ends - WINDOW]) if size >= WINDOW else prefix[:0]
    wanted = ends[: len(rolling)][(rolling & np.uint64((1 << BORDER_BITS) - 1)) == 0]
    texts = np.flatnonzero(np.diff(cuts))
    first = cuts[texts]
    # A window that reaches back into the text before says nothing about this one.
    near = first[np.searchsorted(first, wanted, side="right") - 1] if len(first) else wanted
    borders = np.union1d(first, wanted[(wanted - near >= WINDOW) & (wanted < size)])
    gaps = np.diff(np.append(borders, size))
    long = np.flatnonzero(gaps > LONGEST_CHUNK)
    if len(long):
        more = [np.arange(borders[i] + LONGEST_CHUNK, borders[i] + gaps[i], LONGEST_CHUNK) for i in long]
        borders = np.union1d(borders, np.concatenate(more))
    back = borders
    for _ in range(3):  # a code point has at most three bytes after its first
        back = np.where((back < size) & ((data[np.minimum(back, size - 1)] & 0xC0) == 0x80), back - 1, back)
    starts = np.union1d(first, back)
    ends = np.append(starts[1:], size)
    hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


class Cutter:
    """Token counts and cut positions of the texts of one block."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, cache: ChunkCache):
        self.data, self.cuts = data, cuts
        self.starts, self.ends, hashes = chunk_borders(data, cuts)
        s = cache.summaries(data, self.starts, self.ends, hashes)
        at = np.searchsorted(self.starts, cuts[:-1])
        self.first, self.last = at, np.append(at[1:], len(self.starts))
        heads = np.zeros(len(self.starts) + 1, dtype=bool)
        heads[at] = True
        heads[-1] = True
        # A word that runs on into the next chunk of its text ends there.
        runs_on = s.closes & ~heads[1:] & np.append(s.opens[1:], False)
        self.begun = np.concatenate(([0], np.cumsum(s.words - np.concatenate(([False], runs_on[:-1])))))
        self.ended = np.concatenate(([0], self.begun[1:] - runs_on))
        self.points = np.concatenate(([0], np.cumsum(s.points)))
        self.words = self.begun[self.last] - self.begun[self.first]
        full = self.last > self.first
        tail = np.zeros(len(at), dtype=bool)
        tail[full] = ~s.closes[self.last[full] - 1]
        self.tokens = self.words + tail

    def cut(self, text: int, tokens: int) -> tuple[int, int]:
        """Byte and code point, counted from the text's beginning, after its first ``tokens`` tokens."""
        a, b, low = int(self.first[text]), int(self.last[text]), int(self.cuts[text])
        if tokens == 0:
            return 0, 0
        if tokens == self.tokens[text]:
            return int(self.cuts[text + 1]) - low, int(self.points[b] - self.points[a])
        # Words that have ended up to and with each chunk; the cut is the end of one of them.
        base = int(self.begun[a])
        chunk = a + int(np.searchsorted(self.ended[a + 1 : b + 1] - base, tokens))
        piece = self.data[self.starts[chunk] : self.ends[chunk]]
        inside = ~_SPACE[piece]
        stops = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        end = int(stops[tokens - (int(self.ended[chunk]) - base if chunk > a else 0) - 1])
        points = int(((piece[:end] & 0xC0) != 0x80).sum())
        return int(self.starts[chunk]) + end - low, int(self.points[chunk] - self.points[a]) + points


_cache: list[ChunkCache] = []


def _worker_cache() -> ChunkCache:
    if not _cache:
        _cache.append(ChunkCache())
    return _cache[0]


def _choices(id_col: str, seed: int, plain_share: int, spm_share: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    text = F.col("_text")
    bare = (F.octet_length(text) == 0) | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when(bare | (part(2) % 100 >= plain_share), "plain").when(part(3) % 100 < spm_share, "spm").otherwise("psm")
    return [form.alias("_form"), part(0).alias("_h1"), part(1).alias("_h2")]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, *keep, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs``.

    ``share`` percent of the documents are transformed, ``spm_share`` percent of these suffix first.  Null texts are empty; an empty
    text and one that holds a marker stay plain.  A null id takes part as an empty id.  Rows with equal ids and texts give equal
    rows; other columns are dropped unless named in ``keep``; an empty table gives no rows.
    """
    kept = [F.col(c) for c in keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", *keep, F.col("_text").cast("binary").alias("_text"), *_choices("doc_id", seed, share, spm_share))
    schema = rows.select("doc_id", *keep).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker_cache()
        for batch in batches:
            raw, bounds = text_bytes(batch.column("_text"))
            forms = batch.column("_form").to_pylist()
            h1, h2 = batch.column("_h1").to_pylist(), batch.column("_h2").to_pylist()
            for low, high in blocks(bounds, BLOCK_BYTES):
                data = raw[bounds[low] : bounds[high]]
                cutter = Cutter(data, bounds[low : high + 1] - bounds[low], cache)
                view, prefixes, middles, out = memoryview(data), [], [], []
                for i in range(high - low):
                    a, b = int(cutter.cuts[i]), int(cutter.cuts[i + 1])
                    form, n = forms[low + i], int(cutter.tokens[i])
                    if form == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        out.append(bytes(view[a:b]))
                        continue
                    ends = sorted((h1[low + i] % (n + 1), h2[low + i] % (n + 1)))
                    (p, p_points), (m, m_points) = (cutter.cut(i, e) for e in ends)
                    prefix, middle, suffix = view[a : a + p], view[a + p : a + m], view[a + m : b]
                    parts = (b"<P>", prefix, b"<S>", suffix, b"<M>", middle) if form == "psm" else (b"<S>", suffix, b"<P>", prefix, b"<M>", middle)
                    prefixes.append(p_points)
                    middles.append(m_points - p_points)
                    out.append(b"".join(parts))
                own = [batch.column(c).slice(low, high - low) for c in names[:-5]]
                made = [pa.array(cutter.tokens), pa.array(forms[low:high], pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *made], names)

    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The exact text of an output.  Transformed texts hold no marker, and no marker can arise where parts meet one."""
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    body, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(body, SUFFIX), PREFIX), middle, after(body, SUFFIX))
    spm = F.concat(after(body, PREFIX), middle, after(before(body, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
