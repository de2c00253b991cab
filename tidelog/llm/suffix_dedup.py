"""Exact removal of repeated 200-byte strings: sampled anchors bring equal strings together, hash-compared suffix sorting
finds what they share.

Every ``span``-byte string has one anchor: the ``GRAM``-byte gram of least hash inside it (the leftmost of equals).  It depends
on the string alone, so equal strings anywhere have equal anchors at equal places.  Neighbouring strings share an anchor; such
a run of starts, with the bytes it covers, is a *context*.

* A context whose bytes occur again is repeated as a whole: counting decides it.
* Different contexts around the same anchor form a class.  The suffixes that start at the anchors of a class are merge-sorted;
  two suffixes are compared by binary search for their common extension over prefix polynomial hashes, so a comparison costs
  a logarithm of the span.  Neighbours' extensions to the right give, for every offset of a string around the anchor, the
  groups that agree on its right part; hashes of the left part split them.  What is found equal is compared byte by byte.
* A class of more than ``RUN`` contexts is sorted in salted runs; the distinct strings of the runs then meet by two 64-bit
  hashes in an ordinary aggregation, so that no class is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .shingles import _power_tables, blocks, mix, text_bytes

GRAM = 24
RUN = 4096
RUN_BYTES = 4 << 20
# Fixed-size bitmaps (4 MB) keep most rows that cannot matter out of shuffles; exact joins follow.
MAP_BITS = 25
CHUNK = 1 << 22
_PLACE_BITS = 26


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64, out=prefix[1:])
    return prefix, inverse


def _other_hash(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A second polynomial hash of the strings ``[start, start + size)``, with a base of its own."""
    base = 0xD6E8FEB86659FD93
    steps = np.full(len(data) + 1, np.uint64(base))
    back = np.full(len(data) + 1, np.uint64(pow(base, -1, 1 << 64)))
    steps[0] = back[0] = 1
    prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(7)) * np.cumprod(steps, dtype=np.uint64)[:-1], dtype=np.uint64)))
    return mix((prefix[starts + size] - prefix[starts]) * np.cumprod(back, dtype=np.uint64)[starts])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    count = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _pieces(column: pa.Array, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks ``(bytes, piece bounds, row of each piece, place of each piece in its row)``; long rows in overlapping pieces."""
    raw, bounds = text_bytes(column)
    for first, last in blocks(bounds):
        data = raw[bounds[first] : bounds[last]]
        cuts = bounds[first : last + 1] - bounds[first]
        if last - first == 1 and len(data) > CHUNK:
            for at in range(0, len(data) - span + 1, CHUNK):
                part = data[at : at + CHUNK + span - 1]
                yield part, np.array([0, len(part)]), np.array([first]), np.array([at])
        else:
            yield data, cuts, np.arange(first, last), np.zeros(last - first, dtype=np.int64)


def _contexts(data: np.ndarray, cuts: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """``(gram hash, context hash, piece, anchor, lo, hi)`` of the contexts of a block, places relative to their piece."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < span:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    prefix, inverse = _prefix_hash(data)
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    keys = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place
    least = _least(keys, span - GRAM + 1)
    piece = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    starts = np.arange(len(least))
    fits = starts + span <= cuts[1:][piece[: len(least)]]
    starts = starts[fits]
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    anchor = (least[fits] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    owner = piece[starts]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    lo, anchor, owner = starts[new], anchor[new], owner[new]
    hi = np.concatenate((starts[1:][new[1:]] - 1, starts[-1:]))
    # A run ends where its piece ends; the next start may be far ahead.
    hi = np.minimum(hi, cuts[1:][owner] - span)
    body = (prefix[hi + span] - prefix[lo]) * inverse[lo]
    context = mix(mix(body) + ((anchor - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
    base = cuts[owner]
    return grams[anchor], context, owner, anchor - base, lo - base, hi - base


def _in_map(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot = slot & np.int64((1 << MAP_BITS) - 1)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _bitmap(rows: DataFrame, slot) -> np.ndarray:
    """A bitmap of ``slot & (2**MAP_BITS - 1)`` over all rows: the same size for any number of rows."""
    masked = slot.bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = rows.select(masked.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    out[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _spot(rid: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return rid ^ (anchor << 11) ^ anchor


def _scan_grams(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, cuts, _, _ in _pieces(batch.column(1), span):
                gram, context, *_ = _contexts(data, cuts, span)
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["gram", "context"])

    return run


def _scan_occurrences(span: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for data, cuts, rows, places in _pieces(batch.column(1), span):
                gram, context, piece, anchor, lo, hi = _contexts(data, cuts, span)
                keep = _in_map(shared.value, gram.view(np.int64))
                gram, context, piece, anchor, lo, hi = (x[keep] for x in (gram, context, piece, anchor, lo, hi))
                if len(gram):
                    at = places[piece]
                    arrays = [gram.view(np.int64), context.view(np.int64), rids[rows[piece]], anchor + at, lo + at, hi + at]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["gram", "context", "rid", "anchor", "lo", "hi"])

    return run


def _scan_bodies(span: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for data, cuts, rows, places in _pieces(batch.column(1), span):
                _, _, piece, anchor, lo, hi = _contexts(data, cuts, span)
                rid, spot = rids[rows[piece]], anchor + places[piece]
                keep = np.flatnonzero(_in_map(shared.value, _spot(rid, spot)))
                for at in range(0, len(keep), 4096):
                    k = keep[at : at + 4096]
                    base = cuts[piece[k]]
                    bodies = [data[a:b].tobytes() for a, b in zip((lo[k] + base).tolist(), (hi[k] + base + span).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[k]), pa.array(spot[k]), pa.array(bodies, pa.binary())], ["rid", "anchor", "body"])

    return run


# ---------------------------------------------------------------- hash-compared suffix sort


class Suffixes:
    """Suffixes ``[start, end)`` of one text with a class each, compared through prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.text, self.start, self.end, self.group = text, start, end, group
        self.prefix, self.inverse = _prefix_hash(text)

    def hash(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[a + size] - self.prefix[a]) * self.inverse[a]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``x`` and ``y``, by binary search over hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hash(a, middle) == self.hash(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix ``x`` sorts before ``y``: by class, then by the byte after the common extension."""
        out = self.group[x] < self.group[y]
        peers = np.flatnonzero(self.group[x] == self.group[y])
        if len(peers):
            x, y = x[peers], y[peers]
            common = self.extension(x, y)
            a, b = self.start[x] + common, self.start[y] + common
            over_a, over_b = a >= self.end[x], b >= self.end[y]
            top = len(self.text) - 1
            out[peers] = np.where(over_a | over_b, over_a & ~over_b, self.text[np.minimum(a, top)] < self.text[np.minimum(b, top)])
        return out

    def sort(self) -> np.ndarray:
        """Bottom-up merge sort; every merge places all elements at once by binary search in the sibling run."""
        count = len(self.start)
        order = np.argsort(self.group, kind="stable")
        width = 1
        index = np.arange(count)
        while width < count:
            run = index // width
            right = run % 2 == 1
            low = np.where(right, (run - 1) * width, np.minimum((run + 1) * width, count))
            high = np.where(right, run * width, np.minimum((run + 2) * width, count))
            first = low.copy()
            for _ in range(int(width).bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                own, other = order[open_], order[middle]
                # Elements of the right run go behind equal ones of the left run, so the merge is stable.
                ahead = np.where(right[open_], ~self.before(own, other), self.before(other, own))
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            merged = np.empty(count, dtype=np.int64)
            merged[(run // 2) * 2 * width + index % width + (low - first)] = order
            order, width = merged, width * 2
        return order


def _equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    out = np.empty(len(a), dtype=bool)
    steps = np.arange(span)
    for at in range(0, len(a), 4096):
        part = slice(at, at + 4096)
        out[part] = (text[a[part, None] + steps] == text[b[part, None] + steps]).all(axis=1)
    return out


def repeated_strings(text: np.ndarray, body: np.ndarray, anchor: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts ``text[body[i]:body[i+1]]`` with their anchors: ``(context, start)`` of strings that start at two places or more.

    ``anchor`` and the returned starts are places in ``text``.
    """
    count = len(anchor)
    suffixes = Suffixes(text, anchor, np.minimum(anchor + span, body[1:]), group)
    order = suffixes.sort()
    x, y = order[:-1], order[1:]
    common = np.where(group[x] == group[y], suffixes.extension(x, y), -1)
    found_context, found_start = [], []
    for offset in range(span - GRAM + 1):
        need = span - offset
        start = anchor[order] - offset
        fits = (start >= body[order]) & (start + span <= body[order + 1])
        if fits.sum() < 2:
            continue
        right = np.concatenate(([0], np.cumsum(common < need)))
        which = np.flatnonzero(fits)
        left = suffixes.hash(start[which], np.full(len(which), offset))
        by = np.lexsort((left, right[which]))
        which, left = which[by], left[by]
        twin = (right[which][1:] == right[which][:-1]) & (left[1:] == left[:-1])
        at = np.flatnonzero(twin)
        if len(at):
            a, b = start[which[at]], start[which[at + 1]]
            same = _equal_bytes(text, a, b, span)
            ends = np.unique(np.concatenate((at[same], at[same] + 1)))
            found_context.append(order[which[ends]])
            found_start.append(start[which[ends]])
    if not found_context:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_context), np.concatenate(found_start)


_RUN_SCHEMA = "rid long, start long, stop long, w1 long, w2 long"


def _sort_run(span: int):
    """One run: rows ``(rid, start, stop, w1, w2)``.

    Rows without ``w1`` are intervals in contexts that occur once.  Contexts of a class in several runs also give each of their
    strings with two hashes, to meet the strings of the other runs (``rid`` is null where the context is known to be repeated).
    """

    def run(table: pa.Table) -> pa.Table:
        text, body = text_bytes(table.column("body").combine_chunks())
        text, body = text[body[0] : body[-1]], body - body[0]
        rid, anchor, lo = (table.column(c).to_numpy() for c in ("rid", "anchor", "lo"))
        single, split = (table.column(c).to_numpy() for c in ("single", "split"))
        group = np.unique(table.column("gram").to_numpy(), return_inverse=True)[1]
        context, start = repeated_strings(text, body, body[:-1] + anchor - lo, group, span)
        mine = single[context]
        c, s = context[mine], start[mine] - body[context[mine]] + lo[context[mine]]
        order = np.lexsort((s, c))
        c, s = c[order], s[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)
        last = np.append(new[1:], True)[: len(c)]
        none = pa.nulls(int(new.sum()), pa.int64())
        parts = [pa.table({"rid": pa.array(rid[c[new]]), "start": pa.array(s[new]), "stop": pa.array(s[last] + span), "w1": none, "w2": none})]
        wide = np.flatnonzero(split)
        if len(wide):
            counts = np.diff(body)[wide] - span + 1
            owner = np.repeat(wide, counts)
            starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + body[owner]
            prefix, inverse = _prefix_hash(text)
            w1 = mix((prefix[starts + span] - prefix[starts]) * inverse[starts])
            place = starts - body[owner] + lo[owner]
            arrays = [pa.array(rid[owner], mask=~single[owner]), pa.array(place), pa.array(place + span), pa.array(w1.view(np.int64)), pa.array(_other_hash(text, starts, span).view(np.int64))]
            parts.append(pa.Table.from_arrays(arrays, ["rid", "start", "stop", "w1", "w2"]))
        return pa.concat_tables(parts)

    return run


# ---------------------------------------------------------------- the job


def repeated_intervals(rows: DataFrame, scratch: Scratch, span: int) -> DataFrame:
    """``(rid, start, stop)``: byte intervals of ``rows (rid, text binary)`` covered by repeated strings; they may overlap."""
    spark = rows.sparkSession
    grams = rows.mapInArrow(_scan_grams(span), "gram long, context long").groupBy("gram")
    grams = grams.agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).filter("n > 1")
    grams = scratch.cut(grams.select("gram", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    seen = spark.sparkContext.broadcast(_bitmap(grams, F.col("gram")))
    found = rows.mapInArrow(_scan_occurrences(span, seen), "gram long, context long, rid long, anchor long, lo long, hi long")
    found = scratch.cut(found.join(grams, "gram"), "occurrences")

    contexts = found.groupBy("gram", "mixed", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "anchor", "lo", "hi")).alias("one"))
    contexts = scratch.cut(contexts.select("gram", "mixed", "context", "copies", "one.*"), "contexts")
    again = contexts.filter("copies > 1").select("gram", "context")
    whole = found.join(again, ["gram", "context"]).select("rid", F.col("lo").alias("start"), (F.col("hi") + span).alias("stop"))

    wanted = contexts.filter("mixed")
    sizes = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    total = wanted.agg(F.sum(F.col("hi") - F.col("lo") + span)).first()[0] or 0
    runs = max(1, -(-total // RUN_BYTES))
    split = F.col("n") > RUN
    key = F.struct(
        F.when(split, F.col("gram")).alias("gram"),
        F.when(split, F.pmod(F.xxhash64("rid", "anchor"), F.ceil(F.col("n") / RUN))).otherwise(F.pmod(F.xxhash64("gram"), F.lit(runs))).alias("part"),
    )
    wanted = wanted.join(sizes, "gram").select("gram", "rid", "anchor", "lo", (F.col("copies") == 1).alias("single"), split.alias("split"), key.alias("run"))
    wanted = scratch.cut(wanted, "wanted")
    spots = spark.sparkContext.broadcast(_bitmap(wanted, F.expr("rid ^ shiftleft(anchor, 11) ^ anchor")))
    bodies = rows.mapInArrow(_scan_bodies(span, spots), "rid long, anchor long, body binary")
    # Identical rows share a rid and give the same body twice; one is enough.
    sorted_ = wanted.join(bodies, ["rid", "anchor"]).groupBy("run").applyInArrow(_one_each(_sort_run(span)), _RUN_SCHEMA)
    sorted_ = scratch.cut(sorted_, "sorted")
    inside = sorted_.filter(F.col("w1").isNull()).select("rid", "start", "stop")
    across = sorted_.filter(F.col("w1").isNotNull())
    met = across.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("rid").isNull()).alias("known")).filter("n > 1 OR known").select("w1", "w2")
    across = across.filter(F.col("rid").isNotNull()).join(met, ["w1", "w2"]).select("rid", "start", "stop")
    return whole.unionByName(inside).unionByName(across)


def _one_each(run):
    def once(table: pa.Table) -> pa.Table:
        rid, anchor = table.column("rid").to_numpy(), table.column("anchor").to_numpy()
        order = np.lexsort((anchor, rid))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rid[order][1:] != rid[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
        return run(table.take(pa.array(order[new])))

    return once


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            data = np.frombuffer(text.as_py() or b"", dtype=np.uint8)
            sizes.append(len(data))
            if not found.is_valid or not len(found):
                removed.append(0)
                spans.append(0)
                digests.append(hashlib.sha256(data.tobytes()).hexdigest())
                continue
            depth = np.zeros(len(data) + 1, dtype=np.int32)
            values = found.values
            np.add.at(depth, values.field(0).to_numpy(), 1)
            np.add.at(depth, values.field(1).to_numpy(), -1)
            gone = np.cumsum(depth[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
            digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    A byte goes if a ``span``-byte string that covers it also starts anywhere else, in the same or another text; strings are
    judged on the input and never cross texts.  Null texts count as empty, texts shorter than ``span`` stay whole, identical
    rows are repeats of each other, ids may repeat or be null, other columns are ignored, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    found = repeated_intervals(rows.select("rid", "text"), scratch, span)
    lists = found.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    full = rows.join(lists, "rid", "left").select("doc_id", "text", "spans")
    return full.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
