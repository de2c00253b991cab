"""Queries over hashed vectors: what every page's vector holds, search by them, and link scores by a focus centroid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier, parse, search
from . import Query
from .extract import PARSED_SQL, html_pages
from .lookup import STORED_SQL, stored_documents

DIM = 256
ASKED = "vendor widget3 the tion"
FOCUS = ("vendor", "market the", "tion and the")

# The checksum that deals tokens to buckets, by its bit rule; tokens are ASCII.
_CRC_SQL = f"""crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
bucket AS MATERIALIZED (SELECT token, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(token, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {DIM} AS b
  FROM (SELECT DISTINCT token FROM tokens), crc_table)"""


def _vectors_sql(source: str) -> str:
    """CTEs from ``source``, a query of ``(id, text)``: ``vec (id, b, w)``, unit vectors by bucket."""
    return f"""texts AS MATERIALIZED ({source}),
tokens AS MATERIALIZED (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM texts),
{_CRC_SQL},
counted AS (SELECT id, b, CAST(count(*) AS DOUBLE) AS n FROM tokens JOIN bucket USING (token) GROUP BY id, b),
vec AS MATERIALIZED (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM counted)"""


_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(FOCUS))
_SHOWN = "FROM stored WHERE NOT blocked AND content <> ''"


def _profile(spark, sf):
    v = search.embed_pages(stored_documents(spark, sf), DIM)
    weighed = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c["weight"] * (c["bucket"] + 1))
    return v.select("page_url", "model", "dim", F.size("vector").alias("buckets"), F.round(weighed, 5).alias("weighed"))


def _search(spark, sf):
    p = stored_documents(spark, sf)
    return search.hashed_search(p, search.embed_pages(p, DIM), ASKED, DIM, 20).select("url", "title", F.round("score", 6).alias("score"))


def _focus(spark, sf):
    links = parse.page_links(parse.parse_pages(html_pages(spark, sf))).select("url", "position", "target", "anchor_text")
    score = frontier.centroid_score(F.col("anchor_text"), F.col("target"), search.focus_centroid(FOCUS, DIM), DIM)
    return links.select("url", F.col("position").cast("bigint").alias("position"), F.round(score, 6).alias("score"))


QUERIES = {
    "hashed_vectors": Query(
        _profile,
        f"""WITH {STORED_SQL}, {_vectors_sql(f"SELECT url AS id, content AS text {_SHOWN}")}
        SELECT t.id AS page_url, 'hashing-{DIM}' AS model, {DIM} AS dim, CAST(count(b) AS INTEGER) AS buckets, round(coalesce(sum(w * (b + 1)), 0), 5) AS weighed FROM texts t LEFT JOIN vec USING (id) GROUP BY t.id""",
    ),
    "hashed_search": Query(
        _search,
        f"""WITH {STORED_SQL}, {_vectors_sql(f"SELECT url AS id, content AS text {_SHOWN} UNION ALL SELECT '', '{ASKED}'")},
        scored AS (SELECT v.id AS url, sum(v.w * q.w) AS score FROM vec v JOIN vec q ON q.id = '' AND q.b = v.b WHERE v.id <> '' GROUP BY v.id)
        SELECT url, title, round(score, 6) AS score FROM scored JOIN stored USING (url) ORDER BY score DESC, url DESC LIMIT 20""",
    ),
    "focus_scores": Query(
        _focus,
        f"""WITH {PARSED_SQL}, {_vectors_sql(f"SELECT url || ' ' || position AS id, coalesce(anchor_text, '') || ' ' || target AS text FROM links UNION ALL SELECT '#' || i, w FROM (VALUES {_WORDS}) f(i, w)")},
        mean AS (SELECT b, sum(w) / {len(FOCUS)} AS m FROM vec WHERE id LIKE '#%' GROUP BY b),
        centre AS (SELECT b, m / sqrt(sum(m * m) OVER ()) AS m FROM mean),
        met AS (SELECT id, sum(w * m) AS d FROM vec JOIN centre USING (b) WHERE id NOT LIKE '#%' GROUP BY id)
        SELECT url, position, round(1 + greatest(0, coalesce(d, 0)), 6) AS score FROM links LEFT JOIN met ON id = url || ' ' || position""",
    ),
}
