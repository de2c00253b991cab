"""Queries over discovered links: scores, admission, rediscovery, and the next fetch list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_micros
from ..operators import frontier as fr
from ..operators import parse
from . import Query
from .extract import PARSED_SQL, html_pages
from .inputs import table

WORDS = ("the", "pill", "example.net")
# Path words of the driver's link targets are invented, so each link also gets a path part that the url rules know.
PARTS = ("login", "vendor", "article", "Shop", "privacy", "item", "page", "cart")


def scored_input(spark, sf):
    """Links of the html pages, each with a path part from ``PARTS``; every third page is a targeted lineage."""
    links = parse.page_links(parse.parse_pages(html_pages(spark, sf)))
    part = F.element_at(F.array(*[F.lit(p) for p in PARTS]), (F.col("position") % len(PARTS) + 1).cast("int"))
    return links.select(
        F.col("url").alias("parent_url"),
        "position",
        F.concat(F.regexp_extract("target", "^(https?://[^/]+)", 1), F.lit("/"), part, F.lit("/"), F.length("target").cast("string")).alias("url"),
        "anchor_text",
        (F.length("url") % 3 == 0).alias("targeted"),
        (F.length("url") % 4).cast("int").alias("depth"),
    )


def pinned_hosts(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, sf, "pages").filter(F.length("url") > 42).select(host.alias("hostname")).distinct()


LINKS_SQL = (
    PARSED_SQL
    + f""",
cand AS (SELECT url AS parent_url, position, regexp_extract(target, '^(https?://[^/]+)', 1) || '/' || [{", ".join(repr(p) for p in PARTS)}][position % {len(PARTS)} + 1] || '/' || length(target) AS url,
    target_host AS hostname, anchor_text, length(url) % 3 = 0 AS targeted, length(url) % 4 AS depth FROM links),
pins AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS hostname FROM pages WHERE length(url) > 42),
scored AS (SELECT *, (1 + CAST(contains(h, 'the') AS INT) + CAST(contains(h, 'pill') AS INT) + CAST(contains(h, 'example.net') AS INT))
    * CASE WHEN position % 8 IN (0, 4, 7) THEN 0.05::DOUBLE WHEN position % 8 IN (1, 3, 5) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN targeted AND hostname NOT IN (SELECT hostname FROM pins) THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM (SELECT *, lower(anchor_text || ' ' || url) AS h FROM cand))"""
)


def scored(spark, sf):
    links = scored_input(spark, sf)
    return fr.score_links(links, pinned_hosts(spark, sf), fr.keyword_score(F.col("anchor_text"), F.col("url"), WORDS))


def _scores(spark, sf):
    return scored(spark, sf).select("parent_url", F.col("position").cast("bigint").alias("position"), "url", F.round("score", 6).alias("score"))


def _known(spark, sf):
    """Known pages: the html pages themselves plus, for every second one, the vendor page of its host."""
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    own = p.select("url", host.alias("hostname"), (F.length("url") > 42).alias("pinned"))
    more = p.filter("page_id % 2 = 0").select(F.concat(root, F.lit("/vendor/"), F.length(F.concat(root, F.lit("/and"))).cast("string")).alias("url"), host.alias("hostname"), F.lit(False).alias("pinned"))
    return own.unionByName(more).dropDuplicates(["url"])


KNOWN_SQL = """known AS (SELECT url, any_value(hostname) AS hostname, bool_or(pinned) AS pinned FROM (
  SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS hostname, length(url) > 42 AS pinned FROM pages
  UNION ALL SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/vendor/' || length(regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/and'), regexp_extract(url, '^https?://([^/?#]+)', 1), false FROM pages WHERE page_id % 2 = 0) GROUP BY url)"""


def _admitted(spark, sf):
    children = fr.discovered(scored(spark, sf), max_depth=4, threshold=0.06, allow_clearnet=True)
    return fr.admit(children, _known(spark, sf), host_cap=25, pinned_cap=100).select(
        "url", "hostname", "parent_url", F.col("depth").cast("bigint").alias("depth"), F.round("score", 6).alias("score"), "targeted"
    )


def _admitted_one_cap(spark, sf):
    """Only pinned hosts are capped."""
    children = fr.discovered(scored(spark, sf), max_depth=4, threshold=0.06, allow_clearnet=True)
    return fr.admit(children, _known(spark, sf), host_cap=0, pinned_cap=40).select("url", "hostname", "parent_url")


def _idn_scope(spark, sf):
    """Suppliers as accented hosts, some with ports, user info or blanks."""
    n = F.col("s_suppkey")
    host = F.concat(F.lit("b\u00fccher"), n.cast("string"), F.lit(".Example"))
    url = F.when(n % 4 == 0, F.concat(F.lit("http://"), host, F.lit("/a"))).when(n % 4 == 1, F.concat(F.lit("https://"), host, F.lit(":8080/b"))).when(n % 4 == 2, F.concat(F.lit("http://u@"), host, F.lit("/"))).otherwise(
        F.concat(F.lit("http://"), host, F.lit("/a b"))
    )
    return fr.with_scope_host(table(spark, sf, "supplier").select("s_suppkey", url.alias("url"))).select("s_suppkey", F.col("scope_host").alias("host"))


_ADMIT_SQL = (
    LINKS_SQL
    + ",\n"
    + KNOWN_SQL
    + """,
ch AS (SELECT *, depth + 1 AS d FROM scored WHERE score >= 0.06 AND depth < 4),
fi AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY url ORDER BY position, parent_url) = 1),
fre AS (SELECT * FROM fi WHERE url NOT IN (SELECT url FROM known)),
rk AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY position, parent_url, url) AS r FROM fre),
hc AS (SELECT hostname, count(*) AS n, bool_or(pinned) AS p FROM known GROUP BY hostname)"""
)


def _state(spark, sf):
    """Orders as frontier rows: status from the order status, depth and score from priority and price."""
    o = table(spark, sf, "orders")
    n = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("http://h"), (n % 50).cast("string"), F.lit(".onion/"), F.element_at(F.array(*[F.lit(p) for p in PARTS]), (n % len(PARTS) + 1).cast("int")), F.lit("/"), n.cast("string")).alias("url"),
        F.concat(F.lit("h"), (n % 50).cast("string"), F.lit(".onion")).alias("hostname"),
        F.when(F.col("o_orderstatus") == "O", "discovered").when(n % 11 == 0, "in_progress").when(n % 7 == 0, "dead").otherwise("crawled").alias("status"),
        (n % 7).cast("int").alias("depth"),
        F.round(F.col("o_totalprice") % 5, 2).alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(n % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("next_crawl_at"),
        F.col("o_orderdate").cast("timestamp").alias("claimed_at"),
        F.when(n % 3 == 0, F.sha2(n.cast("string"), 256)).alias("content_sha256"),
        F.lit(2).cast("bigint").alias("consecutive_failures"),
        F.concat(F.lit("http://h"), (n % 50).cast("string"), F.lit(".onion/")).alias("parent_url"),
        (n % 2 == 0).alias("targeted"),
        n.alias("n"),
    )


STATE_SQL = f"""st AS (SELECT 'http://h' || (n % 50) || '.onion/' || [{", ".join(repr(p) for p in PARTS)}][n % {len(PARTS)} + 1] || '/' || n AS url, 'h' || (n % 50) || '.onion' AS hostname,
  CASE WHEN o_orderstatus = 'O' THEN 'discovered' WHEN n % 11 = 0 THEN 'in_progress' WHEN n % 7 = 0 THEN 'dead' ELSE 'crawled' END AS status,
  CAST(n % 7 AS INT) AS depth, round(o_totalprice % 5, 2) AS score, o_orderdate AS created_at, CASE WHEN n % 5 <> 0 THEN o_orderdate END AS next_crawl_at, o_orderdate AS claimed_at,
  CASE WHEN n % 3 = 0 THEN sha256(CAST(n AS VARCHAR)) END AS content_sha256, 'http://h' || (n % 50) || '.onion/' AS parent_url, n % 2 = 0 AS targeted, n FROM (SELECT *, o_orderkey AS n FROM orders))"""
AS_OF = "1997-01-01 00:00:00"
_HOSTS = [f"h{i}.onion" for i in range(0, 50, 2)]


def _batch(spark, sf):
    return fr.next_batch(_state(spark, sf), AS_OF, 200, hosts=_HOSTS).select("url", "score", F.col("depth").cast("bigint").alias("depth"))


def _eligible(spark, sf):
    return _state(spark, sf).filter(fr.eligible(AS_OF)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _rescored(spark, sf):
    pins = table(spark, sf, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string"), F.lit(".onion")).alias("hostname"))
    r = fr.rescore(_state(spark, sf), pins, words=("h1",))
    return r.select("url", "old_score", F.round("score", 6).alias("score"))


def _requested(spark, sf):
    return _state(spark, sf).filter("n % 4 = 1").select("url")


def _requeued(spark, sf):
    return fr.requeue(_state(spark, sf), _requested(spark, sf), AS_OF).select(
        "url", "status", iso_micros(F.col("next_crawl_at")).alias("next_crawl_at"), "consecutive_failures", F.col("depth").cast("bigint").alias("depth"), "parent_url"
    )


def _rediscovered(spark, sf):
    s = _state(spark, sf)
    found = s.select(
        "url", ((F.col("n") * 3) % 8).cast("int").alias("depth"), (F.col("n") % 9).alias("position"), F.lit("http://found.onion/").alias("parent_url")
    )
    return fr.rediscover(s, found).select("url", F.col("depth").cast("bigint").alias("depth"), "parent_url")


_RULE = "CASE WHEN n % 8 IN (0, 4, 7) THEN 0.05::DOUBLE WHEN n % 8 IN (1, 3, 5) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"

# What follows the ASCII letters in the IDNA form of "bücher" and a number of so many digits.
_PUNYCODE = "CASE length(CAST(s_suppkey AS VARCHAR)) WHEN 1 THEN '3ya' WHEN 2 THEN 'n2a' WHEN 3 THEN '65a' WHEN 4 THEN 'q9a' WHEN 5 THEN '9db' WHEN 6 THEN 'thb' END"

QUERIES = {
    "link_scores": Query(_scores, f"WITH {LINKS_SQL} SELECT parent_url, position, url, round(score, 6) AS score FROM scored"),
    "admitted_links": Query(
        _admitted,
        f"""WITH {_ADMIT_SQL} SELECT url, hostname, parent_url, d AS depth, round(score, 6) AS score, targeted FROM rk LEFT JOIN hc USING (hostname)
        WHERE r <= CASE WHEN coalesce(p, false) THEN 100 ELSE 25 END - coalesce(n, 0)""",
    ),
    "admitted_links_one_cap": Query(
        _admitted_one_cap,
        f"""WITH {_ADMIT_SQL} SELECT url, hostname, parent_url FROM rk LEFT JOIN hc USING (hostname) WHERE NOT coalesce(p, false) OR r <= 40 - coalesce(n, 0)""",
    ),
    "idn_scope_hosts": Query(_idn_scope, f"SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'xn--bcher' || s_suppkey || '-' || {_PUNYCODE} || '.example' END AS host FROM supplier"),
    "next_fetch_batch": Query(
        _batch,
        f"""WITH {STATE_SQL} SELECT url, score, depth::BIGINT AS depth FROM (SELECT * FROM st WHERE hostname IN ({", ".join(repr(h) for h in _HOSTS)}) AND depth <= 5
          AND ((status IN ('discovered', 'crawled', 'dead') AND next_crawl_at <= TIMESTAMP '{AS_OF}') OR (status = 'in_progress' AND claimed_at < TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND))
          ORDER BY score DESC, depth, created_at, url LIMIT 200)""",
    ),
    "eligible_pages": Query(
        _eligible,
        f"""WITH {STATE_SQL} SELECT status, count(*) AS n FROM st WHERE depth <= 5
          AND ((status IN ('discovered', 'crawled', 'dead') AND next_crawl_at <= TIMESTAMP '{AS_OF}') OR (status = 'in_progress' AND claimed_at < TIMESTAMP '{AS_OF}' - INTERVAL 300 SECOND)) GROUP BY status""",
    ),
    "rescored_queue": Query(
        _rescored,
        f"""WITH {STATE_SQL}, r AS (SELECT url, score AS old_score, (1 + CAST(contains(lower(url), 'h1') AS INT)) * {_RULE}
            * CASE WHEN targeted AND n % 50 > 24 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS score FROM st WHERE status = 'discovered')
        SELECT url, old_score, round(score, 6) AS score FROM r WHERE abs(score - old_score) > 1e-9""",
    ),
    "requeued_pages": Query(
        _requeued,
        f"""WITH {STATE_SQL}, h AS (SELECT *, n % 4 = 1 AND status <> 'in_progress' AS hit FROM st)
        SELECT url, CASE WHEN hit THEN CASE WHEN content_sha256 IS NOT NULL THEN 'crawled' ELSE 'discovered' END ELSE status END AS status,
          strftime(CASE WHEN hit THEN TIMESTAMP '{AS_OF}' ELSE next_crawl_at END, '%Y-%m-%d %H:%M:%S.%f') AS next_crawl_at, CASE WHEN hit THEN 0::BIGINT ELSE 2::BIGINT END AS consecutive_failures,
          CASE WHEN hit THEN 0::BIGINT ELSE depth::BIGINT END AS depth, CASE WHEN NOT hit THEN parent_url END AS parent_url FROM h""",
    ),
    "rediscovered_pages": Query(
        _rediscovered,
        f"""WITH {STATE_SQL}, h AS (SELECT *, (n * 3) % 8 <= 5 AND (n * 3) % 8 < depth AND status <> 'in_progress' AS up FROM st)
        SELECT url, CASE WHEN up THEN (n * 3) % 8 ELSE depth END AS depth, CASE WHEN up THEN 'http://found.onion/' ELSE parent_url END AS parent_url FROM h""",
    ),
    "scope_preview": Query(
        lambda spark, sf: fr.scope_preview(_state(spark, sf), 3, _HOSTS),
        f"WITH {STATE_SQL} SELECT count(*) AS pages FROM st WHERE depth <= 3 AND hostname IN ({', '.join(repr(h) for h in _HOSTS)})",
    ),
    "cleared_queue": Query(
        lambda spark, sf: fr.clear_queue(_state(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {STATE_SQL} SELECT status, count(*) AS n FROM st WHERE status <> 'discovered' GROUP BY status",
    ),
}
