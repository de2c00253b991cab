"""N-gram Jaccard self-join with several global token orders, reported as connected components.

A pair with Jaccard of at least t must share a token among the first ``n - ceil(t n) + 1`` tokens of both sets under *every*
global order.  Order A sorts frequent tokens last and the rest by hash; its prefixes are joined.  Orders B and C sort by other
hashes, again with frequent tokens last; a pair of order A must also share a prefix token under both before its sets are
compared in full.

Large groups of near copies never become pairs.  Equal sets are one node.  Under each of eight further orders, nodes with the same first
token are joined to the most central ones among them; pairs that met under three of these orders, compared in full, put most near
copies into one component at linear cost.  The exact join then looks only at pairs of nodes from different components, which is all
that connectivity needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import connected_components
from ..session import Scratch
from .shingles import fixed_lists, mix, shingle_blocks, shingle_sets

SEEDS = 8
# Salts of the further orders that every candidate pair has to meet under.
ORDERS = (101, 102)
PIVOTS = 6
# A token in more windows than this is frequent: it goes to the end of every order.
FREQUENT = 32
# In buckets of more nodes a pair must pass a bitmap, and be at its first common token, before it becomes a row.
SCREENED = 6
# Most frequent tokens that are broadcast (8 bytes each); the threshold rises until they fit.
MAX_FREQUENT = 1 << 20
# Bits of the bitmap that bounds the overlap of two sets before they are compared.
BITMAP = 4096
# 2**ID_BITS bits (2 MB) tell which texts may be wanted again; with more ids the bitmap only lets more texts through.
ID_BITS = 24


def prefix_size(n, percent: int):
    """``n - ceil(percent n / 100) + 1``."""
    return n - (percent * n + 99) // 100 + 1


def _fold(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens >> np.uint64(64 - bits)


def _folds(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identity of each row's set, two independent 64-bit folds of all its hashes; 0 for an empty set."""
    nodes, checks = np.zeros(len(offsets) - 1, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        nodes[full] = mix(np.add.reduceat(mix(tokens), offsets[full]))
        checks[full] = mix(np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), offsets[full]) + np.diff(offsets)[full].astype(np.uint64))
    return nodes, checks


def _nodes(tokens: np.ndarray, offsets: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """One long for each row's set: its first fold, or both mixed where different sets have that fold (``twins``, ascending)."""
    nodes, checks = _folds(tokens, offsets)
    if len(twins):
        shared = twins[np.minimum(np.searchsorted(twins, nodes), len(twins) - 1)] == nodes
        nodes = np.where(shared, mix(nodes + mix(checks)), nodes)
    return nodes.view(np.int64)


def _salted(tokens: np.ndarray, salt: int) -> np.ndarray:
    return mix(tokens ^ mix(np.array([salt], dtype=np.uint64)))


def _bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bit for each of ``BITMAP`` parts of the hash space in which a row has a token."""
    marks = np.zeros((len(offsets) - 1, BITMAP), dtype=bool)
    marks[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), (tokens >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def _profiles(words: int, carried: int, twins: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for tokens, offsets in shingle_blocks(batch.column(carried), words):
                rows = len(offsets) - 1
                full = np.flatnonzero(np.diff(offsets))
                seeds = np.zeros((rows, SEEDS), dtype=np.uint64)
                if len(full):
                    for s in range(SEEDS):
                        seeds[full, s] = np.minimum.reduceat(_salted(tokens, s), offsets[full])
                own = batch.slice(at, rows).columns[:carried]
                at += rows
                names = batch.schema.names[:carried]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(offsets)), pa.array(_nodes(tokens, offsets, twins)), pa.array(_folds(tokens, offsets)[1].view(np.int64)), fixed_lists(seeds), fixed_lists(_bitmaps(tokens, offsets))],
                    [*names, "n", "node", "check", "seeds", "bitmap"],
                )

    return run


def _windows(words: int, percent: int, bits: int):
    """Folded tokens of the one and a half prefixes of each text under the plain hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fold(t[: prefix_size(len(t), percent) * 3 // 2], bits) for t in shingle_sets(batch.column(0), words) if len(t)]
            for at in range(0, len(found), 200):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[at : at + 200]).view(np.int64))], ["token"])

    return run


def _tails(words: int, percent: int, bits: int, shared):
    """Folded tokens behind the window, of the texts whose window holds too few tokens that are not frequent for a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for tokens, offsets in shingle_blocks(batch.column(0), words):
                hot = _in(tokens, frequent, bits)
                found = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    size = prefix_size(b - a, percent)
                    window = size * 3 // 2
                    if b - a > window and window - int(hot[a : a + window].sum()) < size:
                        found.append(_fold(tokens[a + window : b], bits))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    return run


def _in(tokens: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), dtype=bool)
    folded = _fold(tokens, bits)
    at = np.minimum(np.searchsorted(frequent, folded), len(frequent) - 1)
    return frequent[at] == folded


def _prefixes(words: int, percent: int, bits: int, shared, twins: np.ndarray):
    """``(token, node, n, place, frequent)`` of the prefix of each set under order A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for tokens, offsets in shingle_blocks(batch.column(0), words):
                hot = _in(tokens, frequent, bits)
                out: list[tuple] = []
                for node, a, b in zip(_nodes(tokens, offsets, twins).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if b > a:
                        size = prefix_size(b - a, percent)
                        own, late = tokens[a:b], hot[a:b]
                        if late[:size].any():
                            cold = own[~late][:size]
                            out.append((np.concatenate((cold, own[late][: size - len(cold)])), node, b - a, len(cold)))
                        else:
                            out.append((own[:size], node, b - a, size))
                if out:
                    yield _posting_rows(out)

    return run


def _posting_rows(out: list[tuple]) -> pa.RecordBatch:
    sizes = [len(x[0]) for x in out]
    at = np.concatenate([np.arange(len(x[0])) for x in out])
    hot = at >= np.repeat([x[3] for x in out], sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
            pa.array(np.repeat(np.array([x[1] for x in out], dtype=np.int64), sizes)),
            pa.array(np.repeat(np.array([x[2] for x in out], dtype=np.int64), sizes)),
            pa.array(at),
            pa.array(hot),
        ],
        ["token", "node", "n", "at", "hot"],
    )


def _sets(words: int, percent: int, bits: int, shared, frequent, orders: tuple[int, ...], twins: np.ndarray):
    """``(node, tokens, head0, ...)`` of the texts whose id may be wanted (a fixed-size bitmap of id hashes).

    ``head0``, ``head1``, ... are the prefixes of the set under each of ``orders``, folded to 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_map, late = shared.value, frequent.value if frequent is not None else np.zeros(0, dtype=np.uint64)
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = (words_map[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            texts = batch.column(1).filter(pa.array(wanted))
            for tokens, offsets in shingle_blocks(texts, words):
                sets = [tokens[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                heads = [[(_heads(t, salt, percent, bits, late) >> np.uint64(32)).astype(np.uint32).view(np.int32) for salt in orders] if len(t) else [()] * len(orders) for t in sets]
                columns = [pa.array([h[i] for h in heads], pa.list_(pa.int32())) for i in range(len(orders))]
                blobs = pa.array([t.tobytes() for t in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(tokens, offsets, twins)), blobs, *columns], ["node", "tokens", *(f"head{i}" for i in range(len(orders)))])

    return run


def _heads(tokens: np.ndarray, salt: int, percent: int, bits: int, frequent: np.ndarray) -> np.ndarray:
    """Prefix of a set under the order (frequent last, salted hash)."""
    size = prefix_size(len(tokens), percent)
    rank = (_salted(tokens, salt) >> np.uint64(1)) | (_in(tokens, frequent, bits).astype(np.uint64) << np.uint64(63))
    return np.sort(tokens[np.argpartition(rank, size - 1)[:size]])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _verify(percent: int):
    """Keep the pairs that pass the exact Jaccard test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (left, right))
                common = _common(a, b)
                kept.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return run


def _may_link(percent: int):
    """False for pairs whose bitmaps already show too many tokens of one set that the other lacks."""

    def lacking(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda acc, k: acc + k)

    most = F.least(F.col("na") - lacking("bitmap_a", "bitmap_b"), F.col("nb") - lacking("bitmap_b", "bitmap_a"))
    return most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``2**ID_BITS`` id hashes, the same size for any number of ids."""
    slot = _slot(F.col("id"))
    words = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << ID_BITS}L) & 63 as int))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (ID_BITS - 6), dtype=np.uint64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(1 << ID_BITS))


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int, bits: int, frequent, twins: np.ndarray, orders: tuple[int, ...], scratch: Scratch, name: str) -> DataFrame:
    """Verified edges ``(a, b)`` of candidate ``pairs``; only texts of nodes in a pair are hashed again.

    A pair must share a prefix token under each of ``orders`` before its sets are brought together.
    """
    spark = docs.sparkSession
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("bitmap_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bitmap_b"))
    pairs = scratch.cut(pairs.join(left, "a").join(right, "b").filter(_may_link(percent)).select("a", "b"), f"{name}-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.cut(nodes.join(ends, "node", "left_semi").select("node", F.col("min_id").alias("id")), f"{name}-wanted")
    ids = spark.sparkContext.broadcast(_id_bitmap(wanted))
    heads = [f"head{i}" for i in range(len(orders))]
    schema = ", ".join(["node long", "tokens binary", *(f"{h} array<int>" for h in heads)])
    sets = docs.select(_slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(_sets(words, percent, bits, ids, frequent, orders, twins), schema)
    first = F.any_value(F.struct("tokens", *heads)).alias("s")
    sets = scratch.cut(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(first).select("node", "s.*"), f"{name}-sets")
    if orders:
        left = sets.select(F.col("node").alias("a"), *(F.col(h).alias(f"{h}_a") for h in heads))
        right = sets.select(F.col("node").alias("b"), *(F.col(h).alias(f"{h}_b") for h in heads))
        met = pairs.join(left, "a").join(right, "b")
        for h in heads:
            met = met.filter(F.arrays_overlap(f"{h}_a", f"{h}_b"))
        pairs = scratch.cut(met.select("a", "b"), f"{name}-met")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verify(percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, component_key)`` and the ``carry`` columns, one row per input row.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over their distinct ``words``-word shingles;
    ``component_id`` is the smallest id reachable by links, ``component_key`` tells components apart even where no id is known.  A null or word-free text has ``n_shingles`` 0, links with nothing
    and is its own component.  Rows that repeat an id are kept; a row with a null id takes part, its component is the smallest
    id that is not null.  An empty table gives no rows; other columns are ignored.  Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    carried = {"doc_id": "long"} | {name: kind for name, kind in docs.select(*carry).dtypes}
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in carried.items())
    twins = np.zeros(0, dtype=np.uint64)
    while True:
        profile = docs.mapInArrow(_profiles(words, len(carried), twins), f"{schema}, n long, node long, check long, seeds array<long>, bitmap array<long>")
        profile = scratch.cut(profile, "profile")
        nodes = profile.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("min_id"), F.any_value("seeds").alias("seeds"), F.any_value("bitmap").alias("bitmap"), F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = scratch.cut(nodes, "nodes")
        # Different sets of one fold: of 10^10 sets three are expected to share theirs, so this is a handful of rows or none.
        found = nodes.filter("low <> high").select("node").toArrow().column(0).to_numpy().view(np.uint64)
        if not len(found):
            break
        twins = np.union1d(twins, found)
    nodes = nodes.drop("low", "high")
    # From here on the table of rows needs neither seeds nor bitmaps; the nodes have them.
    profile = scratch.cut(profile.select(*carried, "n", "node"), "rows")
    scratch.drop("profile")

    slots = nodes.select("node", "n", F.posexplode("seeds").alias("slot", "value"))
    # The pivots of a bucket are its nodes with the most company over all slots: of a family of copies, those they come from.
    shared = slots.join(slots.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), ["slot", "value"])
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    first = Window.partitionBy("slot", "value").orderBy(F.desc("company"), "node")
    pivots = shared.join(company, "node").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= PIVOTS)
    fits = (F.col("n") * 100 >= F.col("na") * percent) & (F.col("na") * 100 >= F.col("n") * percent)
    stars = (
        slots.join(pivots.select("slot", "value", F.col("node").alias("a"), F.col("n").alias("na")), ["slot", "value"])
        .filter((F.col("a") != F.col("node")) & fits)
        .groupBy("a", F.col("node").alias("b"))
        .count()
        .filter("count >= 3")
        .select("a", "b")
    )
    edges = scratch.cut(_linked(stars, docs, nodes, words, percent, 64, None, twins, (), scratch, "star"), "star-edges")
    scratch.drop("star-pairs", "star-wanted", "star-sets")
    roots = scratch.cut(connected_components(edges), "roots")
    scratch.drop("star-edges")

    bits = min(64, max(16, int(profile.agg(F.sum("n")).first()[0] or 1).bit_length() + 8))
    shared = _frequent(docs, words, percent, bits, scratch)
    postings = docs.select("text").mapInArrow(_prefixes(words, percent, bits, shared, twins), "token long, node long, n long, at long, hot boolean")
    candidates = _candidates(postings, roots, nodes, percent, scratch)
    links = _linked(candidates, docs, nodes, words, percent, bits, shared, twins, ORDERS, scratch, "order")
    far = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    far = scratch.cut(far.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "far")
    scratch.drop("mixed", "order-pairs", "order-wanted", "order-sets", "order-met")
    merged = connected_components(far)

    first = nodes.select("node", "min_id").join(roots, "node", "left").select("node", "min_id", F.coalesce("root", "node").alias("near"))
    first = first.join(merged.select(F.col("node").alias("near"), F.col("root").alias("top")), "near", "left")
    first = scratch.cut(first.select("node", "min_id", F.coalesce("top", "near").alias("top")), "tops")
    names = first.groupBy("top").agg(F.min("min_id").alias("component_id"))
    named = first.join(names, "top").select("node", "component_id", F.col("top").alias("component_key"))
    linked = profile.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component_key", *carry)
    alone = profile.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_key"), *carry)
    return linked.unionByName(alone)


def _frequent(docs: DataFrame, words: int, percent: int, bits: int, scratch: Scratch):
    """Broadcast of the frequent tokens: at most ``MAX_FREQUENT`` folded hashes.

    Tokens are counted in windows of one and a half prefixes; texts whose window is mostly frequent are counted whole.
    """
    spark = docs.sparkSession

    def often(tokens: DataFrame, name: str) -> DataFrame:
        return scratch.cut(tokens.groupBy("token").count().filter(F.col("count") > FREQUENT), name)

    def chosen(counts: DataFrame):
        limit, total = FREQUENT, 0
        for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("count")).limit(MAX_FREQUENT).collect():
            total += row["tokens"]
            if total > MAX_FREQUENT:
                limit = row["count"]
                break
        kept = counts.filter(F.col("count") > limit).select("token").distinct().toArrow().column(0).to_numpy()
        return spark.sparkContext.broadcast(np.sort(kept.view(np.uint64)))

    first = often(docs.select("text").mapInArrow(_windows(words, percent, bits), "token long"), "windows")
    more = often(docs.select("text").mapInArrow(_tails(words, percent, bits, chosen(first)), "token long"), "tails")
    return chosen(first.unionByName(more))


def _candidates(postings: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs ``(a, b)`` of nodes from different components that share a prefix token at places that allow a link."""
    columns = ["token", "node", "n", "at"]
    company = Window.partitionBy("token")
    cold = postings.filter(~F.col("hot")).withColumn("lo", F.min("node").over(company)).withColumn("hi", F.max("node").over(company))
    shared = cold.filter("lo != hi").select(columns).unionByName(postings.filter("hot").select(columns))
    near = scratch.cut(shared.join(roots, "node", "left").select(*columns, F.coalesce("root", "node").alias("root")).distinct(), "near")
    mixed = near.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi").select("token", "size")
    near = near.join(mixed, "token")
    # In large buckets a pair must also pass a bitmap before it becomes a row: the whole one in the largest, else a folded one.
    folded = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(BITMAP // 64 - 8), F.lit(8)), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.get("bitmap", j + k))))
    large = near.filter(F.col("size") > SCREENED).join(nodes.select("node", "bitmap"), "node").select(*columns, "root", F.when(F.col("size") > FREQUENT, F.col("bitmap")).otherwise(folded).alias("bitmap"))
    # They also know the tokens before theirs: a pair is made at its first common token, not at each.
    listed = near.join(large.select("node").distinct(), "node").groupBy("node").agg(F.collect_list(F.struct("at", "token")).alias("own"))
    before = F.transform(F.filter("own", lambda x: x["at"] < F.col("at")), lambda x: x["token"])
    large = large.join(listed, "node").withColumn("before", before).drop("own")
    empty = F.lit(None).cast("array<bigint>")
    small = near.filter(F.col("size") <= SCREENED).select(*columns, "root", empty.alias("bitmap"), empty.alias("before"))
    near = scratch.cut(large.unionByName(small), "mixed")
    scratch.drop("near")
    fields = ("node", ""), ("n", "n"), ("at", "i"), ("root", "r"), ("bitmap", "bitmap_"), ("before", "before_")
    a, b = (near.select("token", *(F.col(c).alias(f"{short}{x}") for c, short in fields)) for x in "ab")
    # At the first common token of a pair that links, what is left of both sets still holds the overlap that a link needs.
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    may = F.col("bitmap_a").isNull() | F.col("bitmap_b").isNull() | (~F.arrays_overlap("before_a", "before_b") & _may_link(percent))
    return a.join(b, "token").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & enough & may).select("a", "b").distinct()
