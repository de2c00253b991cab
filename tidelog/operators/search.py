"""Text, identifier and vector search over stored pages."""

from __future__ import annotations

import datetime as dt
import shlex
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import token_bucket
from ..functions.ordered import top_rows
from ..functions.predicates import retained
from ..functions.text import bind
from ..session import small_table

TOKEN = "[a-z0-9]{2,}"
MAX_TERMS = 30
SNIPPET_CHARS, SNIPPET_LEAD = 600, 90
# A batch of query vectors is held by every task; larger batches are scored in several passes.
QUERIES_PER_PASS = 1024
# Urls that are stored several times travel to the pages up to this number; more are joined.
SEVERAL_BROADCAST = 500_000


# --- text ---------------------------------------------------------------------------------------------------------


class Terms(NamedTuple):
    wanted: list[str]
    unwanted: list[str]


def query_terms(q: str) -> Terms:
    """Split a query: blanks separate, quotes keep a phrase whole, a leading ``-`` asks for absence."""
    parts = shlex.split(q)
    if (count := len(parts)) > MAX_TERMS:
        raise ValueError(f"{count} terms in a query; the limit is {MAX_TERMS}")
    terms = Terms([], [])
    for part in parts:
        if not part.startswith("-"):
            terms.wanted.append(part)
        elif part != "-":
            terms.unwanted.append(part.removeprefix("-"))
    return terms


def _words(column: Column) -> Column:
    """Lower-case words joined by single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(column), r"(?U)[^\p{L}\p{N}]+", " ")), F.lit(" "))


def text_search(
    pages: DataFrame,
    indicators: DataFrame,
    q: str = "",
    host: str = "",
    kind: str = "",
    since: dt.date | None = None,
    until: dt.date | None = None,
    engine: str = "literal",
) -> DataFrame:
    """Matching pages with a snippet.  ``literal`` matches substrings, ``phrase`` matches whole words in order."""
    if since and until and since > until:
        raise ValueError(f"empty date range: {since} to {until}")
    wanted, unwanted = query_terms(q)
    full = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    rows = pages.filter(retained())
    if host:
        rows = rows.filter(F.col("hostname") == host.lower())
    if since:
        rows = rows.filter(F.col("content_captured_at") >= F.lit(str(since)).cast("timestamp"))
    if until:
        rows = rows.filter(F.col("content_captured_at") < F.lit(str(until + dt.timedelta(days=1))).cast("timestamp"))
    if engine == "phrase" and wanted:
        words = _words(full)
        for term in wanted:
            rows = rows.filter(words.contains(_words(F.lit(term))))
        for term in unwanted:
            rows = rows.filter(~words.contains(_words(F.lit(term))))
    else:
        lowered = F.lower(full)
        for term in wanted:
            rows = rows.filter(lowered.contains(term.lower()))
        for term in unwanted:
            rows = rows.filter(~lowered.contains(term.lower()))
    if kind:
        holders = indicators.filter(F.col("ioc_type") == kind).select(F.col("page_url").alias("url")).distinct()
        rows = rows.join(holders, "url", "left_semi")
    return rows.select(
        "url", "title", "content_captured_at", snippet(F.col("content"), wanted).alias("snippet"), "content_sha256"
    )


def rank_results(results: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    return results.orderBy(F.desc("content_captured_at"), "url").offset(offset).limit(limit)


def snippet(content: Column, terms: Sequence[str]) -> Column:
    """600 characters starting 90 before the earliest term."""
    body = F.coalesce(content, F.lit(""))
    hits = [F.nullif(F.instr(F.lower(body), t.lower()), F.lit(0)) for t in terms]
    first = F.least(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(1)
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - SNIPPET_LEAD)
    return body.substr(start, F.lit(SNIPPET_CHARS))


def token_index(pages: DataFrame) -> DataFrame:
    """Inverted index ``(token, url, positions)`` of retained pages; one row per page and token, so no token is hot.

    The words of a page are grouped inside its row.  Only words of urls that are stored several times meet in a shuffle.
    """
    words = F.filter(F.split(F.trim(_words(F.concat_ws(" ", "title", "content"))), " "), lambda w: w != "")
    kept = pages.filter(retained())
    several = small_table(kept.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("url").alias("_several")), SEVERAL_BROADCAST)
    rows = kept.select("url", words.alias("_w"))
    again = F.col("url").eqNullSafe(F.col("_several"))
    one = rows.join(several, again, "left_anti").select("url", F.explode(_by_token(F.col("_w"))).alias("t")).select("t.token", "url", "t.positions")
    more = rows.join(several, again, "left_semi").select("url", F.posexplode("_w").alias("position", "token")).groupBy("token", "url").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return one.unionByName(more)


def _by_token(words: Column) -> Column:
    """``(token, positions)`` of every different word: sorting words with their places and measuring runs stays inside the row."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i)["token"] != F.get(w, i - 1)["token"]))
        end = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(w))
        found = bind(
            starts,
            lambda s: F.transform(
                s, lambda p, j: F.struct(F.get(w, p)["token"].alias("token"), F.transform(F.slice(w, p + 1, end(s, j) - p), lambda x: x["position"]).alias("positions"))
            ),
        )
        return F.when(F.size(w) > 0, found)

    return bind(F.array_sort(F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("position")))), runs)


def phrase_lookup(index: DataFrame, phrase: str) -> DataFrame:
    """Urls that hold the words of ``phrase`` in a row, from the inverted index."""
    words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in phrase).split()]
    if not words:
        return index.select("url").limit(0)
    offsets = [(w, i) for i, w in enumerate(words)]
    lookup = F.create_map(
        *[part for w in dict.fromkeys(words) for part in (F.lit(w), F.array(*[F.lit(i) for x, i in offsets if x == w]))]
    )
    starts = (
        index.filter(F.col("token").isin(*dict.fromkeys(words)))
        .select("url", F.explode(lookup[F.col("token")]).alias("_offset"), "positions")
        .select("url", "_offset", F.explode("positions").alias("_p"))
        .groupBy("url", (F.col("_p") - F.col("_offset")).alias("_start"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return starts.filter(F.col("_n") == len(words)).select("url").distinct()


# --- identifiers --------------------------------------------------------------------------------------------------


def exact_search(pages: DataFrame, indicators: DataFrame, value: str, limit: int = 20) -> DataFrame:
    """Pages holding exactly this identifier, in url order."""
    holders = indicators.filter(F.col("value") == value.strip()).select(F.col("page_url").alias("url")).distinct()
    return pages.filter(~F.coalesce("blocked", F.lit(False))).join(holders, "url", "left_semi").orderBy("url").limit(limit)


# --- vectors ------------------------------------------------------------------------------------------------------


def hashed_vector(text: Column, dim: int) -> Column:
    """Unit vector of token counts as a sorted array of ``(bucket, weight)``; empty text gives an empty array.

    Sorting the buckets and measuring runs keeps the work linear in the page and inside the row.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    buckets = F.array_sort(F.transform(tokens, lambda t: token_bucket(t, dim)))

    def runs(b: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(b) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(b, i) != F.get(b, i - 1)))
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda p, j: F.struct(
                    F.get(b, p).alias("bucket"), (F.coalesce(F.get(s, j + 1), F.size(b)) - p).cast("double").alias("weight")
                ),
            ),
        )

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c["weight"] * c["weight"]))
        return bind(
            norm, lambda n: F.transform(counts, lambda c: F.struct(c["bucket"].alias("bucket"), (c["weight"] / n).alias("weight")))
        )

    empty = F.expr("cast(array() as array<struct<bucket: int, weight: double>>)")
    return bind(buckets, lambda b: F.when(F.size(b) == 0, empty).otherwise(bind(runs(b), unit)))


def sparse_dot(vector: Column, weights: Column) -> Column:
    """Dot product of a sparse vector with a bucket -> weight map."""
    return F.aggregate(
        vector, F.lit(0.0), lambda acc, c: acc + c["weight"] * F.coalesce(F.try_element_at(weights, c["bucket"]), F.lit(0.0))
    )


def dense(vector: Column, dim: int) -> Column:
    """Sparse vector as an array of ``dim`` floats."""
    return bind(
        F.map_from_entries(vector),
        lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("float")),
    )


def embed_pages(pages: DataFrame, dim: int) -> DataFrame:
    """Hashed vectors of retained pages: ``(page_url, model, dim, vector)``, rebuilt from the current snapshot."""
    return pages.filter(retained() & (F.col("content") != "")).select(
        F.col("url").alias("page_url"),
        F.lit(f"hashing-{dim}").alias("model"),
        F.lit(dim).alias("dim"),
        hashed_vector(F.col("content"), dim).alias("vector"),
    )


def query_weights(text: str, dim: int) -> Column:
    """Bucket -> weight map of a query string, folded to a literal by the optimizer."""
    return F.map_from_entries(hashed_vector(F.lit(text), dim))


def focus_centroid(words: Sequence[str], dim: int) -> Column:
    """Normalised mean of the hashed vectors of the focus words, as a bucket -> weight map."""
    parts = F.flatten(F.array(*[hashed_vector(F.lit(w), dim) for w in words if w.strip()]))
    n = float(sum(1 for w in words if w.strip()))

    def build(all_parts: Column) -> Column:
        buckets = F.array_distinct(F.transform(all_parts, lambda p: p["bucket"]))
        return F.transform(
            buckets,
            lambda b: F.struct(
                b.alias("bucket"),
                F.aggregate(
                    F.filter(all_parts, lambda p: p["bucket"] == b), F.lit(0.0), lambda acc, p: acc + p["weight"] / n
                ).alias("weight"),
            ),
        )

    def unit(mean: Column) -> Column:
        norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda acc, c: acc + c["weight"] * c["weight"]))
        return bind(norm, lambda v: F.transform(mean, lambda c: F.struct(c["bucket"].alias("bucket"), F.when(v > 0, c["weight"] / v).otherwise(c["weight"]).alias("weight"))))

    return F.map_from_entries(bind(bind(parts, build), unit))


def hashed_search(pages: DataFrame, vectors: DataFrame, query: str, dim: int, k: int = 10) -> DataFrame:
    """Exact cosine ranking of sparse vectors of the matching model; ties go to the larger url."""
    found = vectors.filter((F.col("model") == f"hashing-{dim}") & (F.col("dim") == dim))
    if k < 1 or not query.strip():
        found = found.limit(0)
    scored = found.select(F.col("page_url").alias("url"), sparse_dot(F.col("vector"), query_weights(query, dim)).alias("score"))
    visible = pages.filter(retained()).select("url", "title")
    return scored.join(visible, "url").orderBy(F.desc("score"), F.desc("url")).limit(max(k, 0))


def dense_search(vectors: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], k: int = 10) -> DataFrame:
    """``(query_id, page_url, score)``: the ``k`` best pages per query by dot product, ties to the larger url.

    One scan for all queries: each task multiplies its Arrow batches with the query matrix and keeps ``k`` rows per
    query, so a task emits at most queries x k rows.  Vectors of another length and non-finite scores are skipped.
    """
    results = None
    for start in range(0, len(queries), QUERIES_PER_PASS):
        part = queries[start : start + QUERIES_PER_PASS]
        ids = [q[0] for q in part]
        matrix = np.asarray([q[1] for q in part], dtype=np.float64)

        def best_of_task(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            kept = None
            for batch in batches:
                fits = batch["vector"].map(lambda v: v is not None and len(v) == matrix.shape[1])
                batch = batch[fits]
                if batch.empty:
                    continue
                scores = np.stack(batch["vector"].to_numpy()).astype(np.float64) @ matrix.T
                urls = batch["page_url"].to_numpy()
                frames = [kept] if kept is not None else []
                for j, query_id in enumerate(ids):
                    column = scores[:, j]
                    finite = np.isfinite(column)
                    rows = pd.DataFrame({"query_id": query_id, "page_url": urls[finite], "score": column[finite]})
                    frames.append(rows.sort_values(["score", "page_url"], ascending=False).head(k))
                kept = pd.concat(frames).sort_values(["score", "page_url"], ascending=False).groupby("query_id").head(k)
            if kept is not None:
                yield kept

        found = vectors.select("page_url", "vector").mapInPandas(best_of_task, "query_id string, page_url string, score double")
        top = top_rows(found, ["query_id"], [F.desc("score"), F.desc("page_url")], k, rank="rank")
        results = top if results is None else results.unionByName(top)
    if results is None:
        raise ValueError("no queries given")
    return results


def precision_at_k(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mean share of relevant pages per query.  ``relevant``: ``query_id, page_url``."""
    marked = ranked.join(relevant.withColumn("_hit", F.lit(1)), ["query_id", "page_url"], "left")
    per_query = marked.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("precision"))
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("mean_precision"))
