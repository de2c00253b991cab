"""Queries over text, identifier and vector search."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_micros
from ..operators import search
from ..operators.text_index import TextIndex
from ..session import Scratch
from . import Query
from .extract import INDICATORS_SQL, planted, planted_indicators
from .inputs import table


KEPT_PHRASES = ("End widget3 only", "rewritten widget9 only", "only once", "vendor", "widget5 only")


def stored_documents(spark, sf):
    """Planted documents as stored pages, captured one hour apart."""
    d = planted(spark, sf)
    return d.select(
        F.col("page_url").alias("url"),
        F.regexp_extract("page_url", "^http://([^/]*)", 1).alias("hostname"),
        F.concat(F.lit("Report "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_sha256"),
        (F.col("doc_id") % 17 == 0).alias("blocked"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("content_captured_at"),
        F.lit(False).alias("body_truncated"),
    )


STORED_SQL = INDICATORS_SQL + """,
stored AS (SELECT page_url AS url, regexp_extract(page_url, '^http://([^/]*)', 1) AS hostname, 'Report ' || doc_id AS title, text AS content, sha256(text) AS content_sha256, doc_id % 17 = 0 AS blocked,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS content_captured_at FROM planted)"""
_TS = "strftime(content_captured_at, '%Y-%m-%d %H:%M:%S.%f')"


def _out(df):
    return df.withColumn("content_captured_at", iso_micros(F.col("content_captured_at")))


def _literal(spark, sf):
    return _out(search.text_search(stored_documents(spark, sf), planted_indicators(spark, sf), '"the of" -worthless vendor', since=dt.date(2024, 1, 3), until=dt.date(2024, 2, 20)))


def _by_kind(spark, sf):
    return _out(search.text_search(stored_documents(spark, sf), planted_indicators(spark, sf), "dump", host="SRC4.onion", kind="btc"))


def _phrase(spark, sf):
    return search.text_search(stored_documents(spark, sf), planted_indicators(spark, sf), '"end widget3 only" -worthless', engine="phrase").select("url", "content_sha256")


def _phrase_index(spark, sf):
    return search.phrase_lookup(search.token_index(stored_documents(spark, sf)), "End widget3 only")


def _index_upkeep(spark, sf):
    """An index over every document, then two updates: texts replaced, blocked, removed and brought back; before and after merging."""
    pages = stored_documents(spark, sf).withColumn("n", F.regexp_extract("title", "([0-9]+)", 1).cast("bigint"))
    index = TextIndex(spark, f"{Scratch(spark).root}/index", 16)
    n = F.col("n")
    index.update(pages.filter(n % 10 != 9))
    other = F.concat(F.lit("rewritten widget9 only once "), n.cast("string"))
    index.update(pages.filter((n % 5 == 1) | (n % 10 == 9)).withColumn("content", F.when(n % 5 == 1, other).otherwise(F.col("content"))), pages.filter(n % 7 == 2))
    index.update(pages.filter((n % 15 == 1) | (n % 11 == 4)).withColumn("blocked", F.col("blocked") | (n % 11 == 4)))
    found = [index.lookup(phrase).select(F.lit(phrase).alias("phrase"), F.lit("segments").alias("state"), "url") for phrase in KEPT_PHRASES]
    before = Scratch(spark).cut(reduce(DataFrame.unionByName, found), "before")
    index.merge()
    after = [index.lookup(phrase).select(F.lit(phrase).alias("phrase"), F.lit("merged").alias("state"), "url") for phrase in KEPT_PHRASES]
    return reduce(DataFrame.unionByName, after, before)


def _index(spark, sf):
    """Size of the inverted index per page."""
    idx = search.token_index(stored_documents(spark, sf))
    return idx.groupBy("url").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.size("positions")).alias("positions"))


def _exact(spark, sf):
    return search.exact_search(stored_documents(spark, sf), planted_indicators(spark, sf), " im7@exploit.im ").select("url", "title")


def _results_page(spark, sf):
    return search.rank_results(_literal(spark, sf), limit=10, offset=5).select("url", "title")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.format_string("v%08d", "vec_id").alias("page_url"), F.col("embedding").alias("vector"), "label")


def _centroids(spark, sf):
    """One query per label: the mean vector, rounded so that summation order cannot matter.  At most one row per label."""
    v = _vectors(spark, sf)
    means = (
        v.select("label", F.posexplode("vector").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("q"))
    )
    return [(f"label{r['label']}", r["q"]) for r in means.collect()]


def _dense(spark, sf):
    return search.dense_search(_vectors(spark, sf), _centroids(spark, sf), 10).select("query_id", "page_url", F.round("score", 5).alias("score"))


def _precision(spark, sf):
    found = search.dense_search(_vectors(spark, sf), _centroids(spark, sf), 10)
    relevant = _vectors(spark, sf).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("query_id"), "page_url")
    return search.precision_at_k(found, relevant).select("queries", F.round("mean_precision", 6).alias("mean_precision"))


_VEC_SQL = """v AS (SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS page_url, embedding AS vec, label FROM embeddings),
u AS (SELECT label, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM v),
c AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM u GROUP BY label, i) GROUP BY label),
s AS (SELECT 'label' || c.label AS query_id, page_url, v.label = c.label AS hit, list_dot_product(CAST(vec AS DOUBLE[]), q) AS score FROM v, c),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_url DESC) <= 10)"""


def _hashed_profile(spark, sf):
    """Norm and number of used buckets of every page's hashed vector."""
    v = search.embed_pages(stored_documents(spark, sf), 256)
    return v.select("page_url", F.round(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c["weight"] * c["weight"]), 6).alias("norm"))


QUERIES = {
    "text_search": Query(
        _literal,
        f"""WITH {STORED_SQL}, m AS (SELECT *, lower(title || ' ' || content) AS f, least(coalesce(nullif(instr(lower(content), 'the of'), 0), 999999999), coalesce(nullif(instr(lower(content), 'vendor'), 0), 999999999)) AS p FROM stored)
        SELECT url, title, {_TS} AS content_captured_at, substr(content, greatest(1, CASE WHEN p = 999999999 THEN 1 ELSE p END - 90), 600) AS snippet, content_sha256 FROM m
        WHERE NOT blocked AND contains(f, 'the of') AND contains(f, 'vendor') AND NOT contains(f, 'worthless') AND content_captured_at >= DATE '2024-01-03' AND content_captured_at < DATE '2024-02-21'""",
    ),
    "text_search_by_kind": Query(
        _by_kind,
        f"""WITH {STORED_SQL} SELECT url, title, {_TS} AS content_captured_at, substr(content, greatest(1, coalesce(nullif(instr(lower(content), 'dump'), 0), 1) - 90), 600) AS snippet, content_sha256 FROM stored
        WHERE NOT blocked AND hostname = 'src4.onion' AND contains(lower(title || ' ' || content), 'dump') AND url IN (SELECT page_url FROM indicators WHERE ioc_type = 'btc')""",
    ),
    "text_search_page": Query(
        _results_page,
        f"""WITH {STORED_SQL}, m AS (SELECT *, lower(title || ' ' || content) AS f FROM stored)
        SELECT url, title FROM m WHERE NOT blocked AND contains(f, 'the of') AND contains(f, 'vendor') AND NOT contains(f, 'worthless')
          AND content_captured_at >= DATE '2024-01-03' AND content_captured_at < DATE '2024-02-21' ORDER BY content_captured_at DESC, url LIMIT 10 OFFSET 5""",
    ),
    "phrase_search": Query(
        _phrase,
        rf"""WITH {STORED_SQL}, w AS (SELECT *, ' ' || trim(regexp_replace(lower(title || ' ' || content), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS f FROM stored)
        SELECT url, content_sha256 FROM w WHERE NOT blocked AND contains(f, ' end widget3 only ') AND NOT contains(f, ' worthless ')""",
    ),
    "phrase_index_lookup": Query(
        _phrase_index,
        rf"""WITH {STORED_SQL}, w AS (SELECT *, ' ' || trim(regexp_replace(lower(title || ' ' || content), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS f FROM stored)
        SELECT url FROM w WHERE NOT blocked AND contains(f, ' end widget3 only ')""",
    ),
    "phrase_index_incremental": Query(
        _index_upkeep,
        rf"""WITH {STORED_SQL}, k AS (SELECT *, CAST(regexp_extract(title, '([0-9]+)', 1) AS BIGINT) AS n FROM stored),
        kept AS (SELECT url, title, CASE WHEN n % 5 = 1 AND n % 15 <> 1 THEN 'rewritten widget9 only once ' || n ELSE content END AS content FROM k
          WHERE NOT blocked AND n % 11 <> 4 AND (n % 5 = 1 OR n % 10 = 9 OR n % 7 <> 2)),
        w AS (SELECT url, ' ' || trim(regexp_replace(lower(title || ' ' || content), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS f FROM kept)
        SELECT phrase, state, url FROM w, (SELECT unnest({list(KEPT_PHRASES)!r}) AS phrase), (SELECT unnest(['segments', 'merged']) AS state)
        WHERE contains(f, ' ' || lower(phrase) || ' ')""",
    ),
    "token_index": Query(
        _index,
        rf"""WITH {STORED_SQL}, w AS (SELECT url, unnest(string_split(trim(regexp_replace(lower(title || ' ' || content), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS t FROM stored WHERE NOT blocked)
        SELECT url, count(DISTINCT t) AS tokens, count(*) AS positions FROM w GROUP BY url""",
    ),
    "exact_identifier_search": Query(
        _exact,
        f"WITH {STORED_SQL} SELECT url, title FROM stored WHERE NOT blocked AND url IN (SELECT page_url FROM indicators WHERE value = 'im7@exploit.im') ORDER BY url LIMIT 20",
    ),
    "vector_search": Query(_dense, f"WITH {_VEC_SQL} SELECT query_id, page_url, round(score, 5) AS score FROM r"),
    "retrieval_precision": Query(
        _precision,
        f"WITH {_VEC_SQL} SELECT count(*) AS queries, round(avg(p), 6) AS mean_precision FROM (SELECT query_id, avg(CAST(hit AS INTEGER)) AS p FROM r GROUP BY 1)",
    ),
    "hashed_vector_norms": Query(
        _hashed_profile,
        f"WITH {STORED_SQL} SELECT url AS page_url, CASE WHEN regexp_matches(lower(content), '[a-z0-9]{{2,}}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM stored WHERE NOT blocked AND content <> ''",
    ),
}
