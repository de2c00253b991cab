"""Clusters of reused identifiers, with analyst rejections, and lineage over discovery edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_lookup
from ..schemas import STRONG_TYPES
from ..session import Scratch
from .relations import MAX_IDENTIFIERS, common_identifiers, linking_pages, strong_sightings

# Components with more edges than this are reduced by distributed rounds before the ordered pass.
ORDERED_PASS_EDGES = 200_000
# Pages are counted in 2**PAGE_SLOTS slots; a slot with more rows than this, and over eight times the mean, is not gathered page by page.
PAGE_SLOTS, SLOT_ROWS = 16, 1_000_000
# The bitmap of repeated identifiers has about 32 bits for each, but at most 2**MAX_BITS (16 MB); beyond that more singles count as repeated.
MIN_BITS, MAX_BITS = 16, 27


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum((F.xxhash64("a", "b") % 1_000_003)).alias("s")).first()
    return (row["n"], row["x"], row["s"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = join_lookup(both.filter(F.col("b") > F.col("a")), "a", smallest, 2 * total)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link the smaller neighbours of a node, and the node itself, to the smallest of them (edges have a > b)."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = join_lookup(edges, "a", smallest, total)
    siblings = linked.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return siblings.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, root)`` for every node on an edge ``(a, b)``; the root is the smallest node of the component.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the graph, each round
    is two aggregations and two joins, and the edge table is written out between rounds.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    current = scratch.cut(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _fingerprint(current)
    while seen[0]:
        step = _large_star(current, seen[0])
        step = _small_star(step, seen[0])
        current = scratch.cut(step, "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    # At the fixed point every edge points from a member to its root.
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def _keys() -> Column:
    return F.transform("ids", lambda i: _key(i["ioc_type"], i["value"]))


def _star_edges(pages: DataFrame, max_identifiers: int) -> DataFrame:
    return pages.select("page_url", F.get(_keys(), F.lit(0)).alias("a"), F.explode(F.slice(_keys(), 2, max_identifiers)).alias("b"))


def link_edges(sightings: DataFrame, max_identifiers: int = MAX_IDENTIFIERS) -> DataFrame:
    """Star edges ``(page_url, a, b)`` from the first identifier of a page to each of the others."""
    return _star_edges(linking_pages(sightings, max_identifiers).filter(F.size("ids") > 1), max_identifiers)


def page_components(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of all identifiers on ``pages(page_url, ids)``; the root is the smallest of those that pages link.

    Identifiers of one page only follow that page, so the rounds run over the others.  A page is told by one of its identifiers,
    a common one where it has any.
    """
    common = F.coalesce(F.array_sort(F.transform("common", lambda i: _key(i["ioc_type"], i["value"]))), F.expr("cast(array() as array<string>)"))
    told = pages.join(common_identifiers(pages), "page_url", "left").select(_keys().alias("keys"), common.alias("common"))
    told = scratch.cut(told.select("keys", "common", F.coalesce(F.get("common", F.lit(0)), F.array_min("keys")).alias("hub")), "told")
    links = told.filter(F.size("common") > 1).select(F.col("hub").alias("a"), F.explode(F.slice("common", 2, F.size("common"))).alias("b"))
    hubs = connected_components(links, scratch).select(F.col("node").alias("hub"), F.col("root").alias("group"))
    # The smallest identifier of a group may be one that is on one page only.
    lowest = told.groupBy("hub").agg(F.min(F.array_min("keys")).alias("low")).join(hubs, "hub", "left").withColumn("group", F.coalesce("group", "hub"))
    lowest = scratch.cut(lowest, "lowest")
    roots = lowest.groupBy("group").agg(F.min("low").alias("root"))
    of_hub = scratch.cut(lowest.join(roots, "group").select("hub", "root"), "roots")
    # Common identifiers are on several pages of one group: each is named once.
    return told.select("hub", F.explode("keys").alias("node")).join(of_hub, "hub").select("node", "root").distinct()


def _ordered_unions(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Greedy pass per component: unions in (page, identifier) order, refused when they would join a rejected pair.

    ``edges``: ``component, rank, a, b``; ``rejected``: ``component, x, y``.  Returns ``(node, cluster)``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        foes: dict[str, set[str]] = {}

        def root(n: str) -> str:
            parent.setdefault(n, n)
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        rejects = group[group["kind"] == "r"]
        for x, y in zip(rejects["a"], rejects["b"]):
            foes.setdefault(root(x), set()).add(y)
            foes.setdefault(root(y), set()).add(x)
        links = group[group["kind"] == "e"].sort_values("rank")
        for a, b in zip(links["a"], links["b"]):
            ra, rb = root(a), root(b)
            if ra == rb:
                continue
            fewer, other = (ra, rb) if len(foes.get(ra, ())) <= len(foes.get(rb, ())) else (rb, ra)
            if any(root(f) == other for f in foes.get(fewer, ())):
                continue
            low, high = min(ra, rb), max(ra, rb)
            parent[high] = low
            if high in foes:
                foes.setdefault(low, set()).update(foes.pop(high))
        nodes = sorted(parent)
        return pd.DataFrame({"node": nodes, "cluster": [root(n) for n in nodes]}, columns=["node", "cluster"])

    work = edges.select("component", F.lit("e").alias("kind"), "rank", "a", "b").unionByName(
        rejected.select("component", F.lit("r").alias("kind"), F.lit(0).cast("bigint").alias("rank"), F.col("x").alias("a"), F.col("y").alias("b"))
    )
    return work.groupBy("component").applyInPandas(run, "node string, cluster string")


def _relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between clusters: self loops removed, parallel edges reduced to their smallest rank."""
    m = mapping.select(F.col("node").alias("_n"), F.col("cluster").alias("_c"))
    out = edges
    for side in ("a", "b"):
        out = out.join(m, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_c", side)).drop("_n", "_c")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return (
        out.filter(F.col("a") != F.col("b"))
        .select("component", "rank", low.alias("a"), high.alias("b"))
        .groupBy("component", "a", "b")
        .agg(F.min("rank").alias("rank"))
    )


def contract_unmarked(edges: DataFrame, marked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Shrink a component to the clusters around its marked nodes without changing the ordered result.

    A cluster without marked nodes is never refused, and before its own smallest edge nothing touches it; so joining it
    along that edge early changes no decision.  Each round does this for all such clusters at once, which at least
    halves their number.  What remains has at most one cluster per marked node.

    Returns ``(node -> cluster, remaining edges)``.
    """
    tainted = marked.select(F.col("node").alias("_m")).distinct()
    rest = scratch.cut(_relabel(edges, edges.sparkSession.createDataFrame([], "node string, cluster string")), "rest")
    mapping = scratch.cut(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("cluster")), "map"
    )
    while True:
        ends = rest.select("rank", F.col("a").alias("c"), F.col("b").alias("o")).unionByName(
            rest.select("rank", F.col("b").alias("c"), F.col("a").alias("o"))
        )
        free = ends.join(tainted, F.col("c") == F.col("_m"), "left_anti")
        chosen = free.groupBy("c").agg(F.min_by("o", "rank").alias("o"))
        merges = connected_components(chosen.select(F.col("c").alias("a"), F.col("o").alias("b")), Scratch(rest.sparkSession))
        if merges.isEmpty():
            return mapping, rest
        # A merged cluster keeps the name of its marked node, if it has one (it has at most one).
        names = (
            merges.join(tainted.withColumn("_is", F.lit(True)), F.col("node") == F.col("_m"), "left")
            .groupBy("root")
            .agg(F.coalesce(F.max(F.when(F.col("_is"), F.col("node"))), F.min("node")).alias("name"))
        )
        renamed = scratch.cut(merges.join(names, "root").select("node", F.col("name").alias("cluster")), "renamed")
        step = renamed.select(F.col("node").alias("_n"), F.col("cluster").alias("_c"))
        mapping = scratch.cut(
            mapping.join(step, F.col("cluster") == F.col("_n"), "left").select("node", F.coalesce("_c", "cluster").alias("cluster")), "map"
        )
        rest = scratch.cut(_relabel(rest, renamed), "rest")


def resolve_clusters(
    indicators: DataFrame,
    reviews: DataFrame | None = None,
    max_identifiers: int = MAX_IDENTIFIERS,
    ordered_pass_edges: int = ORDERED_PASS_EDGES,
) -> DataFrame:
    """``(ioc_type, value, cluster)`` of every strong identifier, honouring rejected pairs.

    Plain connected components first.  Only components that contain a rejected pair see the order-dependent pass, and
    those above ``ordered_pass_edges`` edges are shrunk to their marked clusters beforehand.
    """
    spark = indicators.sparkSession
    scratch = Scratch(spark)
    sightings = strong_sightings(indicators)
    pages = scratch.cut(linking_pages(sightings, max_identifiers).filter(F.size("ids") > 1), "pages")
    components = scratch.cut(page_components(pages, scratch), "components")
    nodes = sightings.select("ioc_type", "value").distinct().withColumn("node", _key(F.col("ioc_type"), F.col("value")))
    assigned = components.withColumnRenamed("root", "cluster")
    if reviews is not None:
        rejected = reviews.filter(F.col("verdict") == "rejected").select(
            _key(F.col("left_type"), F.col("left_value")).alias("x"), _key(F.col("right_type"), F.col("right_value")).alias("y")
        )
        inside = (
            rejected.filter(F.col("x") != F.col("y"))
            .join(components.select(F.col("node").alias("x"), F.col("root").alias("component")), "x")
            .join(components.select(F.col("node").alias("y"), F.col("root").alias("_cy")), "y")
            .filter(F.col("component") == F.col("_cy"))
            .select("component", "x", "y")
            .distinct()
        )
        inside = scratch.cut(inside, "rejected")
        if not inside.isEmpty():
            assigned = _constrained(_star_edges(pages, max_identifiers), components, assigned, inside, scratch, ordered_pass_edges)
    return nodes.join(assigned, "node", "left").select("ioc_type", "value", F.coalesce("cluster", "node").alias("cluster"))


def _constrained(edges, components, assigned, inside, scratch, ordered_pass_edges):
    touched = inside.select("component").distinct()
    members = components.withColumnRenamed("root", "component").join(touched, "component", "left_semi")
    # A global sort gives every link its place in (page, identifier) order; writing it out fixes the numbers.
    ranked = scratch.cut(
        edges.join(members.select(F.col("node").alias("a"), "component"), "a")
        .orderBy("page_url", "b")
        .select("component", F.monotonically_increasing_id().alias("rank"), "a", "b"),
        "ranked",
    )
    sizes = ranked.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > ordered_pass_edges).select("component")
    direct = _ordered_unions(ranked.join(large, "component", "left_anti"), inside.join(large, "component", "left_anti"))
    if large.isEmpty():
        redone = direct
    else:
        big_rejects = inside.join(large, "component", "left_semi")
        marked = big_rejects.select(F.col("x").alias("node")).union(big_rejects.select("y")).distinct()
        mapping, rest = contract_unmarked(ranked.join(large, "component", "left_semi"), marked, scratch)
        # The remaining groups hold at most one cluster per reviewed identifier.
        final = _ordered_unions(rest, big_rejects).select(F.col("node").alias("_k"), F.col("cluster").alias("_f"))
        merged = mapping.join(final, F.col("cluster") == F.col("_k"), "left").select("node", F.coalesce("_f", "cluster").alias("cluster"))
        redone = direct.unionByName(merged)
    redone = scratch.cut(redone, "redone")
    return assigned.join(members.select("node"), "node", "left_anti").select("node", "cluster").unionByName(redone)


def _named_actors(members: DataFrame) -> DataFrame:
    return members.filter((F.col("identifiers") >= 2) | (F.col("page_count") >= 2)).select(
        F.sha2(_key(F.col("first.ioc_type"), F.col("first.value")), 256).alias("actor_id"),
        _key(F.col("first.ioc_type"), F.col("first.value").substr(1, 64)).alias("label"),
        "identifiers",
        "page_count",
        "cluster",
    )


def actors(indicators: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(actor_id, label, identifiers, page_count)``; one identifier on one page is not an actor.

    The label is the smallest identifier of the cluster, and the id is its hash.
    """
    members = clusters.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("identifiers"), F.min(F.struct("ioc_type", "value")).alias("first")
    )
    pages = (
        strong_sightings(indicators)
        .join(clusters, ["ioc_type", "value"])
        .select("cluster", "page_url")
        .distinct()
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("page_count"))
    )
    return _named_actors(members.join(pages, "cluster"))


def actor_identifiers(actor_table: DataFrame, clusters: DataFrame) -> DataFrame:
    return clusters.join(actor_table.select("cluster", "actor_id"), "cluster").select("actor_id", "ioc_type", "value")


def _repeated_marks(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Bitmap ``(_w, _bits)`` over the hashes of identifiers that ``rows`` name more than once, and its width."""
    hashes = rows.select(F.xxhash64("ioc_type", "value").alias("h")).repartition("h")
    repeated = scratch.cut(hashes.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    width = min(max((32 * repeated.count()).bit_length(), MIN_BITS), MAX_BITS)
    slot = F.col("h").bitwiseAND((1 << width) - 1)
    marks = repeated.select(F.shiftright(slot, 6).alias("_w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_bits"))
    return scratch.cut(marks, "marks"), width


def _gathered(rows: DataFrame, scratch: Scratch, max_identifiers: int) -> DataFrame:
    """``(page_url, links, ids)``: the distinct identifiers of every page, ``links`` where they are at most ``max_identifiers``.

    One shuffle by page.  Pages in overfull slots are told apart by a count of slots; of those, pages that link nothing come in pieces.
    """
    keys = ["page_url", "ioc_type", "value"]
    entry = F.struct("ioc_type", "value", "created_at", "repeated")
    place = F.xxhash64("page_url").bitwiseAND((1 << PAGE_SLOTS) - 1)
    sizes = scratch.cut(rows.groupBy(place.alias("_slot")).agg(F.count(F.lit(1)).alias("n")), "slots")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    full = F.broadcast(sizes.filter(F.col("n") > max(SLOT_ROWS, 8 * total >> PAGE_SLOTS)).select("_slot"))  # at most 2**PAGE_SLOTS rows
    merged = [F.min("created_at").alias("created_at"), F.max("repeated").alias("repeated")]
    if full.isEmpty():
        each = rows.repartition("page_url").groupBy(*keys).agg(*merged)
        pages = each.groupBy("page_url").agg(F.collect_list(entry).alias("ids"))
        return pages.select("page_url", (F.size("ids") <= max_identifiers).alias("links"), "ids")
    placed = rows.withColumn("_slot", place)
    small = placed.join(full, "_slot", "left_anti").repartition("page_url").groupBy(*keys).agg(*merged)
    small = small.groupBy("page_url").agg(F.collect_list(entry).alias("ids")).select("page_url", (F.size("ids") <= max_identifiers).alias("links"), "ids")
    large = scratch.cut(placed.join(full, "_slot", "left_semi").groupBy(*keys).agg(*merged), "large")
    linking = linking_pages(large.withColumn("context", F.lit(None).cast("string")), max_identifiers).select(F.col("page_url").alias("_page"), F.lit(True).alias("_links"))
    told = large.join(linking, F.col("page_url").eqNullSafe(F.col("_page")), "left").withColumn("links", F.coalesce("_links", F.lit(False)))
    piece = F.when(F.col("links"), 0).otherwise(F.pmod(F.xxhash64("ioc_type", "value"), F.lit(4096)).cast("int"))
    pieces = told.groupBy("page_url", "links", piece.alias("_piece")).agg(F.collect_list(entry).alias("ids")).drop("_piece")
    return small.unionByName(pieces)


def attributed(indicators: DataFrame, carried: dict[str, Column] | None = None, max_identifiers: int = MAX_IDENTIFIERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters without reviews as ``(firsts, actors, members)``, each identifier standing in ``firsts`` and at most once in ``members``.

    ``indicators``: ``page_url, ioc_type, value, created_at``.  ``firsts`` has every strong identifier with its first sighting, ``actors`` the rows
    of :func:`actors`, ``members`` the ``ioc_type, value, actor_id`` of the identifiers of actors and the columns ``carried`` over from their actor.
    Rows without a value are left out.

    An identifier that is named once follows its page and takes part in no join of its own; hashes tell which are (identifiers of
    the same hash count as repeated, which changes no result).  Pages are gathered once and meet their cluster once.
    """
    scratch = Scratch(indicators.sparkSession)
    rows = indicators.filter(F.col("ioc_type").isin(*STRONG_TYPES)).filter("value IS NOT NULL").select("page_url", "ioc_type", "value", "created_at")
    marks, width = _repeated_marks(rows, scratch)
    h = F.xxhash64("ioc_type", "value")
    met = rows.withColumns({"_w": F.shiftright(h.bitwiseAND((1 << width) - 1), 6), "_h": h}).join(F.broadcast(marks), "_w", "left")  # at most 2**MAX_BITS / 64 rows
    told = met.select("page_url", "ioc_type", "value", "created_at", F.coalesce(F.expr("shiftright(_bits, cast(_h & 63 as int)) & 1L = 1L"), F.lit(False)).alias("repeated"))
    bare = lambda i: F.struct(i["ioc_type"].alias("ioc_type"), i["value"].alias("value"), i["created_at"].alias("created_at"))
    pages = scratch.cut(
        _gathered(told, scratch, max_identifiers).select(
            "page_url", "links", F.transform(F.filter("ids", lambda i: i["repeated"]), bare).alias("shared"), F.transform(F.filter("ids", lambda i: ~i["repeated"]), bare).alias("single")
        ),
        "pages",
    )
    keyed = lambda c: F.array_sort(F.transform(c, lambda i: _key(i["ioc_type"], i["value"])))
    # A page that links is told by one of its identifiers, a repeated one where it has any.
    linking = pages.filter("links").select("page_url", "shared", "single", keyed("shared").alias("common"), F.array_min(keyed("single")).alias("_own"))
    linking = linking.withColumn("hub", F.coalesce(F.get("common", F.lit(0)), "_own"))
    links = linking.filter(F.size("common") > 1).select(F.col("hub").alias("a"), F.explode(F.slice("common", 2, F.size("common"))).alias("b"))
    found = connected_components(links, scratch).select(F.col("node").alias("hub"), F.col("root").alias("group"))
    named = F.transform("single", lambda i: F.struct(i["ioc_type"].alias("ioc_type"), i["value"].alias("value")))
    hubs = linking.groupBy("hub").agg(
        F.min(F.least(F.get("common", F.lit(0)), "_own")).alias("low"), F.sum(F.size("single")).alias("identifiers"), F.count(F.lit(1)).alias("page_count"), F.min(F.array_min(named)).alias("first")
    )
    hubs = scratch.cut(hubs.join(found, "hub", "left").withColumn("group", F.coalesce("group", "hub")), "hubs")
    roots = hubs.groupBy("group").agg(F.min("low").alias("cluster"))
    hubs = scratch.cut(hubs.join(roots, "group").drop("group", "low"), "roots")

    sighted = pages.select("page_url", F.when(F.col("links"), F.array_min(keyed("shared"))).alias("hub"), F.explode("shared").alias("i"))
    shared = sighted.groupBy("i.ioc_type", "i.value").agg(F.min(F.struct("page_url", "i.created_at")).alias("s"), F.max("hub").alias("hub"))
    shared = shared.join(hubs.select("hub", "cluster"), "hub", "left").select("ioc_type", "value", "s", F.coalesce("cluster", _key(F.col("ioc_type"), F.col("value"))).alias("cluster"))
    shared = scratch.cut(shared, "shared")
    # A repeated identifier also counts the pages that link nothing; a single one there is no actor.
    elsewhere = pages.filter("NOT links").select("page_url", F.explode("shared").alias("i")).select("page_url", "i.ioc_type", "i.value")
    elsewhere = elsewhere.join(shared.select("ioc_type", "value", "cluster"), ["ioc_type", "value"]).select("cluster", "page_url").distinct()

    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parts = hubs.select("cluster", "identifiers", "page_count", "first")
    parts = parts.unionByName(shared.select("cluster", one.alias("identifiers"), none.alias("page_count"), F.struct("ioc_type", "value").alias("first")))
    parts = parts.unionByName(elsewhere.select("cluster", none.alias("identifiers"), one.alias("page_count"), F.lit(None).cast("struct<ioc_type: string, value: string>").alias("first")))
    people = parts.groupBy("cluster").agg(F.sum("identifiers").alias("identifiers"), F.sum("page_count").alias("page_count"), F.min("first").alias("first"))
    people = scratch.cut(_named_actors(people), "actors")

    more = list(carried or {})
    owner = scratch.cut(people.select("cluster", "actor_id", *[c.alias(name) for name, c in (carried or {}).items()]), "owner")
    by_hub = hubs.select("hub", "cluster").join(owner, "cluster").drop("cluster")
    of_single = linking.filter(F.size("single") > 0).select("hub", "single").join(by_hub, "hub").select(F.explode("single").alias("i"), "actor_id", *more)
    of_single = of_single.select("i.ioc_type", "i.value", "actor_id", *more)
    members = shared.join(owner, "cluster").select("ioc_type", "value", "actor_id", *more).unionByName(of_single)
    firsts = pages.select("page_url", F.explode("single").alias("i")).select("i.ioc_type", "i.value", "page_url", "i.created_at")
    firsts = firsts.unionByName(shared.select("ioc_type", "value", "s.page_url", "s.created_at"))
    return firsts, people, members


def rank_actors(actor_table: DataFrame, limit: int = 50) -> DataFrame:
    return actor_table.orderBy(F.desc("page_count"), "label").limit(limit)


def lineage(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Urls of the seeds and of everything discovered beneath them (``url, parent_url``).

    Each page has one parent, so ancestors are followed by pointer doubling: the number of rounds is the logarithm of
    the depth.  A round without a new page proves that none is left.
    """
    scratch = Scratch(pages.sparkSession)
    targets = seeds.select(F.col("url").alias("_seed")).distinct().withColumn("_is", F.lit(True))
    current = scratch.cut(
        pages.join(targets, F.col("url") == F.col("_seed"), "left").select("url", F.col("parent_url").alias("up"), F.coalesce("_is", F.lit(False)).alias("hit")),
        "walk",
    )
    reached, total = current.filter("hit").count(), current.count()
    while True:
        above = current.select(F.col("url").alias("up"), F.col("up").alias("_up2"), F.col("hit").alias("_hit2"))
        # Reached pages and roots need no further lookup, so only open pages are shuffled.
        is_open = ~F.col("hit") & F.col("up").isNotNull()
        open_pages = current.filter(is_open)
        moved = join_lookup(open_pages, "up", above, total).select("url", F.col("_up2").alias("up"), F.col("_hit2").alias("hit"))
        orphans = open_pages.join(above.select("up"), "up", "left_anti").select("url", F.lit(None).cast("string").alias("up"), "hit")
        current = scratch.cut(current.filter(~is_open).unionByName(moved).unionByName(orphans), "walk")
        now = current.filter("hit").count()
        if now == reached:
            return current.filter("hit").select("url")
        reached = now
