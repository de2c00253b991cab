"""Queries that look up stored records: listings, breaches, one page, actors, hosts, current versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, records, relations, views
from . import Query
from .extract import CREDENTIALS_SQL, INDICATORS_SQL, LISTINGS_SQL, planted, planted_indicators, planted_listings
from .graph import CLUSTERS_SQL, PAIRS_SQL, order_identifiers
from .inputs import STATE_SQL, captures, state, table
from .lookup import STORED_SQL, stored_documents

URL = "http://src3.onion/d3"


def _cheap(spark, sf):
    listings = planted_listings(spark, sf).withColumn("vendor", F.regexp_extract("page_url", "^http://([^/]*)", 1))
    return views.filter_listings(listings, vendor="src7.onion", max_price=250.0).select("page_url", "product", "price")


def _breach(spark, sf):
    return views.breach_lookup(records.extract_credentials(planted(spark, sf)), email="USER7@leak.example", domain="LEAK.example")


def _breach_many(spark, sf):
    """Every document source asks for the leak domain and for a domain of its own."""
    own = table(spark, sf, "documents").select(F.concat("source", F.lit(".example")).alias("domain"))
    wanted = own.unionByName(table(spark, sf, "region").select(F.when(F.col("r_regionkey") >= 0, "Leak.Example").alias("domain")))
    return views.breach_lookup_many(records.extract_credentials(planted(spark, sf)), wanted)


def _detail(spark, sf):
    d = views.page_detail(stored_documents(spark, sf), planted_indicators(spark, sf), URL)
    return d.select("url", "title", "content_sha256", F.array_join(F.transform("indicators", lambda i: F.concat(i["ioc_type"], F.lit("="), i["value"])), " ").alias("indicators"))


def _ranked_actors(spark, sf):
    ids = order_identifiers(spark, sf)
    return clusters.rank_actors(clusters.actors(ids, clusters.resolve_clusters(ids)), 50).select("label", "page_count")


def _ranked_pairs(spark, sf):
    p = relations.pair_counts(relations.identifier_pairs(order_identifiers(spark, sf)))
    return relations.rank_pairs(p, 100, 10).select("key", "source_count")


def _hosts(spark, sf):
    return views.hosts_known(state(spark, sf).withColumn("pinned", F.col("url").endswith("u1") | F.col("url").endswith("u7")))


def _current(spark, sf):
    """Derived rows of every stored body, reduced to those of the page's current version."""
    rows = captures(spark, sf).filter("ok").select("page_url", "content_sha256", F.sha2("content", 256).alias("value")).distinct()
    return records.current_version_rows(rows, state(spark, sf))


_IND = "ioc_type || '=' || value"

QUERIES = {
    "listings_by_vendor": Query(
        _cheap, f"WITH {LISTINGS_SQL} SELECT page_url, product, price FROM listings WHERE page_url LIKE 'http://src7.onion/%' AND price <= 250"
    ),
    "breach_lookup": Query(
        _breach, f"WITH {CREDENTIALS_SQL} SELECT email, split_part(email, '@', -1) AS domain, page_url FROM creds WHERE email = 'user7@leak.example' AND split_part(email, '@', -1) = 'leak.example'"
    ),
    "breach_lookup_many": Query(
        _breach_many,
        f"""WITH {CREDENTIALS_SQL} SELECT email, split_part(email, '@', -1) AS domain, page_url FROM creds
        WHERE split_part(email, '@', -1) = 'leak.example' OR split_part(email, '@', -1) IN (SELECT lower(source) || '.example' FROM documents)""",
    ),
    "page_detail": Query(
        _detail,
        f"""WITH {STORED_SQL}, i AS (SELECT page_url, string_agg({_IND}, ' ' ORDER BY ioc_type, value) AS indicators FROM indicators WHERE page_url = '{URL}' GROUP BY 1)
        SELECT url, title, content_sha256, indicators FROM stored LEFT JOIN i ON url = page_url WHERE url = '{URL}'""",
    ),
    "actor_ranking": Query(_ranked_actors, f"WITH {CLUSTERS_SQL} SELECT substr(cluster, 1, 70) AS label, page_count FROM actors ORDER BY page_count DESC, label LIMIT 50"),
    "pair_ranking": Query(_ranked_pairs, f"WITH {PAIRS_SQL} SELECT key, source_count FROM pairs ORDER BY source_count DESC, key LIMIT 100 OFFSET 10"),
    "hosts_known": Query(_hosts, f"WITH {STATE_SQL} SELECT hostname, count(*) AS known, bool_or(url LIKE '%u1' OR url LIKE '%u7') AS pinned FROM state GROUP BY hostname"),
    "current_version_rows": Query(
        _current,
        f"""WITH {STATE_SQL}, r AS (SELECT DISTINCT page_url, content_sha256, sha256(content) AS value FROM captures WHERE ok)
        SELECT r.* FROM r JOIN state s ON r.page_url = s.url AND r.content_sha256 = s.content_sha256 WHERE NOT s.blocked""",
    ),
}
