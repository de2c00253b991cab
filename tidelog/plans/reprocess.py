"""Queries over reprocessing: stored pages read again by every extractor, and what of it reaches the derived tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.reprocess import ROW_KEY, PageExtractor, reprocess, standard_extractors, store
from ..session import Scratch
from ..sources.page_tables import PageTables
from . import Query
from .extract import CREDENTIALS_SQL, INDICATORS_SQL, LISTINGS_SQL, PARSED_SQL, PLANTED_SQL, SUFFIX_SQL, suffix
from .inputs import table

BUCKETS = 16


def read_facts(url: str, text: str, blocks: list) -> list[dict]:
    """The JSON object after the word ``facts``; raises where it is cut."""
    found, _ = json.JSONDecoder().raw_decode(text[text.rindex("facts {") + 6 :])
    return [{"name": k, "value": str(v)} for k, v in found.items()]


FACTS = PageExtractor("facts", "facts", "name: string, value: string", read_facts)


def _stored(spark, sf):
    """Pages and documents as stored: most pages with html (one in four with a product table), the rest and all documents as text.

    The facts of every fourth are cut; some are blocked or dead.  The text beside stored html is out of date.
    """
    n = F.col("n")
    facts = F.concat(F.lit(' facts {"seller": "s'), (n % 7).cast("string"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit('", "stock": '), (n % 50).cast("string"), F.lit("}"))))
    planted = F.concat(suffix(n), facts)
    product = F.when(n % 4 == 1, F.concat(F.lit("<table><tr><td>Notebook"), n.cast("string"), F.lit("</td><td>$"), (n % 90 + 1).cast("string"), F.lit(".25</td></tr></table>"))).otherwise("")
    html = F.replace("html", F.lit("<body>"), F.concat(F.lit("<body><p>"), planted, F.lit("</p>"), product))
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("n"), "url", F.when(n % 6 != 0, html).alias("html"), F.when(n % 6 != 0, "out of date").otherwise(F.concat(F.lit("plain"), planted)).alias("content")
    )
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("n"), F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("html"), F.concat("text", planted).alias("content")
    )
    return pages.unionByName(documents).withColumns({"content_sha256": F.sha2("content", 256), "status": F.when(n % 19 == 0, "dead").otherwise("crawled"), "blocked": n % 17 == 0})


def _before(pages) -> dict:
    """What an earlier version of the extractors left: one row a page in every table."""
    url, n = F.col("url").alias("page_url"), F.col("n").cast("string")
    key = n.alias(ROW_KEY)
    none = F.lit(None).cast("string")
    old = F.concat(F.lit("old"), n)
    return {
        "indicators": pages.select(url, key, F.lit("handle").alias("ioc_type"), old.alias("value"), none.alias("context")),
        "credentials": pages.select(url, key, F.concat(old, F.lit("@old.example")).alias("email"), F.lit("old.example").alias("domain"), F.sha2(n, 256).alias("password_sha256")),
        "listings": pages.select(url, key, old.alias("product"), none.alias("vendor"), F.lit(1.0).alias("price"), F.lit("USD").alias("currency"), none.alias("context")),
        "facts": pages.select(url, key, F.lit("old").alias("name"), n.alias("value")),
    }


# How a row of each table is shown, as SQL.
SHOWN = {
    "indicators": "concat(ioc_type, ':', value)",
    "credentials": "email",
    "listings": "concat(cast(round(price * 100) as bigint), ':', coalesce(product, ''))",
    "facts": "concat(name, '=', value)",
}


def _reprocessed_pages(spark, sf):
    """The derived tables after the pass, and the errors it stored.  Meanwhile some pages got a new body, were blocked or taken up by a fetch."""
    pages = _stored(spark, sf)
    tables = PageTables(spark, f"{Scratch(spark).root}/derived", BUCKETS)
    for name, rows in _before(pages).items():
        tables.create(name, rows)
    n = F.col("n")
    current = pages.withColumns(
        {
            "content_sha256": F.when(n % 11 == 5, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_sha256")),
            "status": F.when(n % 13 == 6, "in_progress").otherwise(F.col("status")),
            "blocked": F.col("blocked") | (n % 23 == 7),
        }
    )
    outcome = store(reprocess(pages, [*standard_extractors(), FACTS], key="n"), current.withColumn(ROW_KEY, n), tables)
    shown = outcome.select("page_url", F.lit("errors").alias("stored_in"), F.explode("errors").alias("e")).select("page_url", "stored_in", F.concat_ws(":", "e.extractor", "e.error_type").alias("item"))
    for name, item in SHOWN.items():
        shown = shown.unionByName(tables.read(name).select("page_url", F.lit(name).alias("stored_in"), F.expr(item).alias("item")))
    return shown


_FACTS_SQL = """' facts {"seller": "s' || (doc_id % 7) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '", "stock": ' || (doc_id % 50) || '}' END"""
_OWN = len(PLANTED_SQL)
# Identifiers follow the number of the page or document, which the twins of the extractors call doc_id.
REPROCESSED_SQL = f"""WITH pg AS (SELECT page_id, page_id AS doc_id, url, replace(html, '<body>', '<body><p>' || {SUFFIX_SQL} || {_FACTS_SQL} || '</p>'
    || CASE WHEN doc_id % 4 = 1 THEN '<table><tr><td>Notebook' || doc_id || '</td><td>$' || (doc_id % 90 + 1) || '.25</td></tr></table>' ELSE '' END) AS html FROM (SELECT *, page_id AS doc_id FROM pages)),
{PARSED_SQL.replace("FROM pages)", "FROM pg)")},
every AS (SELECT url AS page_url, page_id AS doc_id, page_id % 6 <> 0 AS html, CASE WHEN page_id % 6 <> 0 THEN p.text ELSE 'plain' || {SUFFIX_SQL} || {_FACTS_SQL} END AS text FROM (SELECT *, page_id AS doc_id FROM parsed) p
  UNION ALL SELECT 'http://' || source || '.onion/d' || doc_id, doc_id, false, text || {SUFFIX_SQL} || {_FACTS_SQL} FROM documents),
planted AS (SELECT page_url, doc_id, html, text FROM every WHERE text IS NOT NULL AND doc_id % 19 <> 0 AND doc_id % 17 <> 0 AND doc_id % 11 <> 5 AND doc_id % 13 <> 6 AND doc_id % 23 <> 7){INDICATORS_SQL[_OWN:]}{CREDENTIALS_SQL[_OWN:]}{LISTINGS_SQL[_OWN:]},
block AS (SELECT page_url, doc_id FROM planted WHERE html AND doc_id % 4 = 1),
fresh AS (
  SELECT page_url, 'indicators' AS stored_in, ioc_type || ':' || value AS item FROM indicators
  UNION ALL SELECT page_url, 'credentials', email FROM creds
  UNION ALL SELECT page_url, 'listings', CAST(round(price * 100) AS BIGINT) || ':' || coalesce(product, '') FROM listings WHERE page_url NOT IN (SELECT page_url FROM block)
  UNION ALL SELECT page_url, 'listings', (doc_id % 90 + 1) || '25:Notebook' || doc_id FROM block
  UNION ALL SELECT page_url, 'facts', unnest(['seller=s' || (doc_id % 7), 'stock=' || (doc_id % 50)]) FROM planted WHERE doc_id % 4 <> 0),
former AS (SELECT page_url, doc_id, unnest(['indicators', 'credentials', 'listings', 'facts']) AS stored_in, unnest(['handle:old' || doc_id, 'old' || doc_id || '@old.example', '100:old' || doc_id, 'old=' || doc_id]) AS item FROM every)
SELECT * FROM fresh UNION ALL SELECT page_url, 'errors', 'facts:JSONDecodeError' FROM planted WHERE doc_id % 4 = 0
UNION ALL SELECT page_url, stored_in, item FROM former WHERE page_url NOT IN (SELECT page_url FROM planted) OR (stored_in = 'facts' AND doc_id % 4 = 0)"""

QUERIES = {"reprocessed_pages": Query(_reprocessed_pages, REPROCESSED_SQL)}
