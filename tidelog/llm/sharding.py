"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition, overfull ranges divided.

Records are ordered by a hash of their text, so equal texts are neighbours and form one group.  Groups that fill more than a share of a
shard are few and are dealt first, whole, to the emptiest shards; a group is divided only where no shard has room for it.  The
others follow from a size-weighted sample of their keys: its quantiles, in proportion to the room that is left in every
shard, are the boundaries of the shards.  The exact bytes of the ranges between them then show which shards are overfull; the end of
such a range, group by group, goes to the shards that are not full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

# Groups of equal texts that fill more than 1/HOT_SHARE of a shard are dealt one by one; there are fewer than HOT_SHARE * shards.
HOT_SHARE = 50
PARTS = 4096
MAX_RANGES = 4096
RANGE_BYTES = 64 << 20
SAMPLES_PER_RANGE = 32


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _range_of(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Add ``range``: how many splitters are not above ``(key, part)``, found by binary search over two literal arrays."""
    depth = (len(splitters) + 1 - 1).bit_length()
    size = (1 << depth) - 1
    top = ((1 << 63) - 1, 1 << 30)
    padded = splitters + [top] * (size - len(splitters))
    keys = F.lit([s[0] for s in padded]) if padded else None
    parts = F.lit([s[1] for s in padded]) if padded else None
    rows = rows.withColumn("range", F.lit(0))
    for level in reversed(range(depth)):
        step = 1 << level

        def reached(at: Column) -> Column:
            key, part = F.get(keys, at), F.get(parts, at)
            return (F.col("key") > key) | ((F.col("key") == key) & (F.col("part") >= part))

        rows = rows.withColumn("range", F.col("range") + F.when(reached(F.col("range") + F.lit(step - 1)), F.lit(step)).otherwise(F.lit(0)))
    return rows


def _deal(groups: list[tuple[int, int]], parts: dict[int, list[tuple[int, int]]], shards: int, total: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Shards of the large groups ``(bytes, key)``: ``{(key, part): shard}``, part -1 for whole groups, and the load of each shard.

    Largest first, each to the emptiest shard; one that finds no room below the mean and a ``HOT_SHARE``-th is divided by its ``parts``.
    """
    mean, loads, dealt, late = total / shards, [0] * shards, {}, []
    for size, key in sorted(groups, key=lambda g: (-g[0], g[1])):
        least = min(range(shards), key=lambda s: (loads[s], s))
        if loads[least] + size <= mean * (1 + 1 / HOT_SHARE):
            dealt[key, -1] = least
            loads[least] += size
        else:
            late.append(key)
    for key in late:
        order = sorted(range(shards), key=lambda s: (loads[s], s))
        for part, size in sorted(parts[key]):
            while len(order) > 1 and loads[order[0]] + size / 2 > mean:
                order.pop(0)
            dealt[key, part] = order[0]
            loads[order[0]] += size
    return dealt, loads


def _boundaries(sample: list[tuple[int, float]], room: list[float], ranges: int) -> tuple[list[int], list[int]]:
    """Ascending cut keys, and the shard of each range between them.

    ``sample`` has keys and weights in ascending order.  Cuts stand at the quantiles that part the weight as ``room`` does, where a new
    shard begins, and at even quantiles in between.
    """
    weight, free = sum(w for _, w in sample), sum(room)
    if not weight or not free:
        return [], [max(range(len(room)), key=lambda s: room[s])]
    wanted, upto = [(i / ranges, 0) for i in range(1, ranges)], 0.0
    for r in room[:-1]:
        upto += r
        wanted.append((upto / free, 1))
    begins: dict[int, int] = {}
    at, seen = 0, 0.0
    for quantile, begin in sorted(wanted):
        while at < len(sample) - 1 and seen + sample[at][1] <= quantile * weight:
            seen += sample[at][1]
            at += 1
        begins[sample[at][0]] = begins.get(sample[at][0], 0) + begin
    cuts = sorted(begins)
    shard_of = [0]
    for cut in cuts:
        shard_of.append(shard_of[-1] + begins[cut])
    return cuts, shard_of


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row, under the law ``bytes``.

    The size of a record is the UTF-8 length of its text plus 1 (null and empty: 1).  Shards differ from the mean by less than two
    ``HOT_SHARE``-ths of it plus one record.  Equal texts share a shard; only where no shard has room for all of them are they
    divided, at random.  ``slot`` numbers the records of a shard from 0 without gaps.  Null ids sort first; rows that
    repeat an id keep their own slots; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, keep=4)
    # The random part is stored with the row; between rows of one text it decides nothing that could be told apart.
    rows = scratch.cut(_sizes(docs, id_col, text_col).withColumn("draw", F.floor(F.rand(17) * PARTS).cast("int")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(total // (HOT_SHARE * shards), 1)
    # Fewer than HOT_SHARE * shards groups hold more than that part of all bytes.
    large = scratch.cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit), "large")
    groups = [(r["bytes"], r["key"]) for r in large.collect()]
    # Only groups that might be divided are looked at part by part: those of over half a shard, fewer than 2 * shards.
    halves = [k for size, k in groups if 2 * shards * size > total]
    parts: dict[int, list[tuple[int, int]]] = {k: [] for k in halves}
    for r in rows.filter(F.col("key").isin(halves)).groupBy("key", "draw").agg(F.sum("size").alias("bytes")).collect() if halves else []:
        parts[r["key"]].append((r["draw"], r["bytes"]))
    for size, key in groups:
        parts.setdefault(key, [(-1, size)])
    dealt, loads = _deal(groups, parts, shards, total)
    fixed = spark.createDataFrame([(k, p, s) for (k, p), s in dealt.items()], "key long, part int, shard int")
    marks = F.broadcast(spark.createDataFrame([(k, True) for _, k in groups], "key long, large boolean"))
    # Large groups are counted and numbered part by part, whether they stay whole or not.
    isolated = F.coalesce("large", F.lit(False))
    rows = rows.join(marks, "key", "left").select("doc_id", "size", "text_crc32", "key", F.when(isolated, F.col("draw")).otherwise(0).alias("part"), isolated.alias("large"))

    small = rows.filter(~F.col("large"))
    rest = total - sum(size for size, _ in groups)
    room = [max(0.0, total / shards - load) for load in loads]
    ranges = int(min(MAX_RANGES, max(4 * shards, total // RANGE_BYTES)))
    rate = ranges * SAMPLES_PER_RANGE / max(rest, 1)
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # About ranges * SAMPLES_PER_RANGE rows are drawn, whatever the size of the table; a large record stands for its size.
    sample = sorted((r["key"], max(1.0, r["size"] * rate)) for r in small.filter(draw < F.col("size") * rate).select("key", "size").collect())
    cuts, shard_of = _boundaries(sample, room, ranges)
    ranged = _range_of(small, [(c, 0) for c in cuts])
    units = ranged.groupBy("range", "key", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    per_range = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    units = scratch.cut(units.withColumn("bytes_in", F.coalesce(F.sum("bytes").over(per_range), F.lit(0))), "units")

    # At most MAX_RANGES and the number of shards: the exact bytes of the ranges.
    exact = {r["range"]: r["bytes"] for r in units.groupBy("range").agg(F.sum("bytes").alias("bytes")).collect()}
    filled = [0] * shards
    places = []
    for number, shard in enumerate(shard_of):
        places.append((number, shard, filled[shard]))
        filled[shard] += exact.get(number, 0)
    scale = rest / sum(room) if sum(room) else 0.0
    caps = [r * scale for r in room]
    over, before = 0.0, []
    for shard in range(shards):
        before.append(over)
        over += max(0.0, filled[shard] - caps[shard])
    facts = F.broadcast(spark.createDataFrame([(n, s, at, float(caps[s]), float(before[s])) for n, s, at in places], "range int, own int, at long, cap double, before double"))
    middle = F.col("at") + F.col("bytes_in") + F.col("bytes") / 2
    other, upto = F.col("own"), 0.0
    spare = [(s, caps[s] - filled[s]) for s in range(shards) if caps[s] > filled[s]]
    beyond = F.col("before") + middle - F.col("cap")
    if spare:
        other = F.lit(spare[-1][0])
        bounds = []
        for shard, free in spare[:-1]:
            upto += free
            bounds.append((upto, shard))
        for bound, shard in reversed(bounds):
            other = F.when(beyond < bound, shard).otherwise(other)
    placed = units.join(facts, "range").select("key", "part", "rows", "range", F.when(middle <= F.col("cap"), F.col("own")).otherwise(other).cast("int").alias("shard"))
    large_units = rows.filter("large").groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    whole, divided = F.broadcast(fixed.filter("part < 0").drop("part")), F.broadcast(fixed.filter("part >= 0"))
    large_units = large_units.join(whole, "key").select("key", "part", "rows", "shard").unionByName(large_units.join(divided, ["key", "part"]).select("key", "part", "rows", "shard"))
    placed = placed.unionByName(large_units.select("key", "part", "rows", (-1 - F.pmod("part", F.lit(64))).alias("range"), "shard"))

    inside = Window.partitionBy("shard", "range").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = scratch.cut(placed.withColumn("rows_in", F.coalesce(F.sum("rows").over(inside), F.lit(0))), "placed")
    # One row for each shard and range.
    totals = placed.groupBy("shard", "range").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(totals.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    placed = placed.join(starts, ["shard", "range"]).select("key", "part", "shard", (F.col("start") + F.col("rows_in")).alias("first_slot"))
    in_unit = F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id")) - 1
    numbered = rows.select("doc_id", "size", "text_crc32", "key", "part", in_unit.alias("nth"))
    return numbered.join(placed, ["key", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
