"""Queries over text and html: gate, parse, indicators, credentials, listings, annotations, extraction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hosts
from ..functions.identity import base58check_valid
from ..operators import gate, indicators, parse, records
from ..session import Scratch
from . import Query
from .inputs import table, texts

# Public example addresses: the first pair carries a correct checksum, the second pair has one digit changed.
GOOD_ADDRESSES = ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy")
BAD_ADDRESSES = ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLz")


def _priced_at(n):
    return F.concat(F.lit(" only $"), (n % 500 + 1).cast("string"), F.lit(".50 today "))


def suffix(n, priced=None):
    """Labelled identifiers built from the number ``n``; with a price where ``priced`` holds, or everywhere."""
    s = n.cast("string")
    own_key = F.sha1(F.concat(F.lit("k"), s))
    hex40 = F.when(n % 5 == 0, own_key).otherwise(F.sha1(s))
    return F.concat(
        F.lit(" Vendor: seller"), (n % 97).cast("string"),
        F.lit(" contact ops"), (n % 53).cast("string"), F.lit("@proton.me or mail victim"), s, F.lit("@corp.example"),
        F.lit(" Jabber: im"), (n % 31).cast("string"), F.lit("@exploit.im"),
        F.lit(" eth 0x"), hex40, F.lit(" ref CVE-2024-"), (n % 9000 + 1000).cast("string"),
        F.lit(" btc "), F.element_at(F.array(*[F.lit(a) for a in GOOD_ADDRESSES + BAD_ADDRESSES]), (n % 4 + 1).cast("int")),
        F.lit(" dump user"), s, F.lit("@leak.example:pw"), s, F.lit("x end widget"), (n % 11).cast("string"), _priced_at(n) if priced is None else F.when(priced, _priced_at(n)).otherwise(" on request "),
        F.when(n % 2 == 0, F.concat(F.lit("PGP key 0x"), own_key, F.lit(" "))).otherwise(F.lit("")),
        F.when(n % 3 == 0, F.lit("-----BEGIN PGP PUBLIC KEY BLOCK----- cut ")).otherwise(F.lit("")),
    )


def planted(spark, sf, priced=None):
    """Documents with a suffix of labelled identifiers built from the document id; with a price where ``priced`` holds, or everywhere."""
    n = F.col("doc_id")
    s = n.cast("string")
    return texts(spark, sf, "documents").select(
        F.concat(F.lit("http://"), "source", F.lit(".onion/d"), s).alias("page_url"), F.concat("text", suffix(n, priced)).alias("text"), "doc_id", "lang"
    )


_ADDR = "[" + ", ".join(f"'{a}'" for a in GOOD_ADDRESSES + BAD_ADDRESSES) + "]"
SUFFIX_SQL = f"""' Vendor: seller' || (doc_id % 97) || ' contact ops' || (doc_id % 53) || '@proton.me or mail victim' || doc_id || '@corp.example Jabber: im' || (doc_id % 31)
    || '@exploit.im eth 0x' || CASE WHEN doc_id % 5 = 0 THEN sha1('k' || doc_id) ELSE sha1(CAST(doc_id AS VARCHAR)) END || ' ref CVE-2024-' || (doc_id % 9000 + 1000) || ' btc ' || {_ADDR}[doc_id % 4 + 1]
    || ' dump user' || doc_id || '@leak.example:pw' || doc_id || 'x end widget' || (doc_id % 11) || ' only $' || (doc_id % 500 + 1) || '.50 today '
    || CASE WHEN doc_id % 2 = 0 THEN 'PGP key 0x' || sha1('k' || doc_id) || ' ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '-----BEGIN PGP PUBLIC KEY BLOCK----- cut ' ELSE '' END"""
PLANTED_SQL = f"""planted AS (
  SELECT 'http://' || source || '.onion/d' || doc_id AS page_url, doc_id, lang,
    text || {SUFFIX_SQL} AS text
  FROM documents)"""

_CONTACT = ", ".join(f"'{d}'" for d in indicators.CONTACT_DOMAINS)
_STOP = ", ".join(f"'{w}'" for w in indicators.HANDLE_STOPWORDS)
_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# Distinct values per type and page.
INDICATORS_SQL = (
    PLANTED_SQL
    + rf""",
keys AS (
  SELECT DISTINCT page_url, text, upper(regexp_replace(unnest(regexp_extract_all(text, '(?i)\b(?:[A-F0-9]{{4}}[ \t]+){{9}}[A-F0-9]{{4}}\b')), '[ \t]', '', 'g')) AS fp FROM planted
  UNION SELECT page_url, text, upper(unnest(regexp_extract_all(text, 'PGP key 0x([a-f0-9]{{40}})\b', 1))) FROM planted),
found AS (
  SELECT page_url, text, 'btc' AS ioc_type, unnest(regexp_extract_all(text, '\b(?:bc1[ac-hj-np-z02-9]{{11,71}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}})\b')) AS value FROM planted
  UNION ALL SELECT page_url, text, 'eth', unnest(regexp_extract_all(text, '\b0x[a-fA-F0-9]{{40}}\b')) FROM planted
  UNION ALL SELECT page_url, text, 'pgp_fp', fp FROM keys
  UNION ALL SELECT page_url, text, 'pgp', 'present' FROM planted WHERE contains(text, 'BEGIN PGP PUBLIC KEY BLOCK') AND page_url NOT IN (SELECT page_url FROM keys)
  UNION ALL SELECT page_url, text, 'cve', unnest(regexp_extract_all(text, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) FROM planted
  UNION ALL SELECT page_url, text, 'onion', unnest(regexp_extract_all(text, '(?i)\b[a-z2-7]{{56}}\.onion\b')) FROM planted
  UNION ALL SELECT page_url, text, 'jabber', unnest(regexp_extract_all(text, '(?i)(?:jabber|xmpp)\b\s*(?:id|address)?\s*[:\-=]?\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1)) FROM planted
  UNION ALL SELECT page_url, text, 'mail', unnest(regexp_extract_all(text, '{_MAIL}')) FROM planted
  UNION ALL SELECT page_url, text, 'handle', unnest(regexp_extract_all(text, '(?i)\b(?:vendor|seller)\s*(?:name)?\s*:\s*([A-Za-z0-9][A-Za-z0-9_.\-]{{2,31}})\b', 1)) FROM planted
  UNION ALL SELECT page_url, text, 'handle', unnest(regexp_extract_all(text, '(?i)\bsold\s+by\s*:?\s*([A-Za-z0-9][A-Za-z0-9_.\-]{{2,31}})\b', 1)) FROM planted),
ind0 AS (
  SELECT DISTINCT page_url, text, CASE WHEN ioc_type <> 'mail' THEN ioc_type
      WHEN lower(split_part(value, '@', -1)) LIKE '%.onion' OR lower(split_part(value, '@', -1)) IN ({_CONTACT}) THEN 'contact_email' ELSE 'email' END AS ioc_type, value
  FROM found f
  WHERE (ioc_type <> 'btc' OR value LIKE 'bc1%' OR value IN ('{GOOD_ADDRESSES[0]}', '{GOOD_ADDRESSES[1]}'))
    AND (ioc_type <> 'eth' OR NOT EXISTS (SELECT 1 FROM keys k WHERE k.page_url = f.page_url AND k.fp = upper(substr(f.value, 3))))
    AND (ioc_type <> 'handle' OR lower(value) NOT IN ({_STOP}))
    AND (ioc_type <> 'mail' OR NOT EXISTS (SELECT 1 FROM found j WHERE j.page_url = f.page_url AND j.ioc_type = 'jabber' AND j.value = f.value))),
indicators AS (
  SELECT page_url, ioc_type, value, CASE WHEN p > 0 THEN substr(text, greatest(p - 80, 1), p + length(value) + 80 - greatest(p - 80, 1)) END AS context
  FROM (SELECT *, instr(lower(text), lower(value)) AS p FROM ind0))"""
)


def planted_indicators(spark, sf):
    return indicators.extract_indicators(planted(spark, sf))


def _indicator_counts(spark, sf):
    return planted_indicators(spark, sf).groupBy("ioc_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("value").alias("distinct_values"))


def _checksums(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*[F.lit(a) for a in GOOD_ADDRESSES + BAD_ADDRESSES]), (F.col("doc_id") % 4 + 1).cast("int")).alias("address"))
    return d.select("doc_id", "address", base58check_valid(F.col("address")).alias("valid"))


CREDENTIALS_SQL = PLANTED_SQL + r""",
creds AS (
  SELECT DISTINCT page_url, lower(m) AS email, s AS secret FROM (
    SELECT page_url, unnest(regexp_extract_all(text, '\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\s*[:|]\s*(\S{3,80})', 1)) AS m,
      unnest(regexp_extract_all(text, '\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\s*[:|]\s*(\S{3,80})', 2)) AS s FROM planted))"""


def planted_listings(spark, sf, priced=None):
    return records.extract_listings(planted(spark, sf, priced))


def _listing_prices(spark, sf):
    return planted_listings(spark, sf).select("page_url", "price", "currency", "product")


# Offsets are rebuilt by splitting at the prices; only '$' amounts occur in the driver tables (the checks would show others).
LISTINGS_SQL = PLANTED_SQL + r""",
l0 AS (SELECT page_url, text, regexp_extract_all(text, '\$\s?\d{1,7}(?:\.\d{1,2})?') AS hits FROM planted),
l1 AS (SELECT page_url, text, unnest(range(1, len(hits) + 1)) AS i, hits FROM l0),
l2 AS (SELECT page_url, text, i, hits[i] AS hit, list_sum(list_transform(string_split_regex(text, '\$\s?\d{1,7}(?:\.\d{1,2})?')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS start FROM l1),
l3 AS (SELECT page_url, i, hit, substr(text, CAST(greatest(start - 70, 0) AS BIGINT) + 1, CAST(start - greatest(start - 70, 0) AS BIGINT)) AS w, start > 70 AS cut,
    CASE WHEN start > 70 THEN substr(text, CAST(start - 70 AS BIGINT), 1) END AS edge, substr(text, CAST(greatest(start - 24, 0) AS BIGINT) + 1, CAST(start - greatest(start - 24, 0) AS BIGINT)) AS near FROM l2),
l4 AS (SELECT page_url, i, CAST(regexp_extract(hit, '\d+(?:\.\d+)?') AS DOUBLE) AS price, 'USD' AS currency,
    trim(regexp_replace(CASE WHEN cut AND NOT regexp_matches(edge, '^\s') AND contains(w, ' ') THEN substr(w, instr(w, ' ') + 1) ELSE w END, '\s+', ' ', 'g')) AS product
  FROM l3 WHERE NOT regexp_matches(near, '(?i)(?:\b(?:from|to|between|upto|up\s+to)\s*|[-–—~]\s*)$')),
listings AS (SELECT page_url, any_value(price) AS price, any_value(currency) AS currency, nullif(product, '') AS product FROM l4 GROUP BY page_url, round(price, 8), product)"""


RULES = ((1, "finance", "worthless"), (2, "greeting", r"\bthe\s+of\b"), (3, "rare", "source17"), (4, "numbers", r"\d{5,}"))


def _rules(spark):
    return spark.createDataFrame(list(RULES), "position INT, category STRING, pattern STRING")


def _gate_input(spark, sf):
    return texts(spark, sf, "documents").select(
        F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        F.when(F.col("doc_id") % 10 == 3, "image/png").otherwise("text/html").alias("content_type"),
        F.sha2("text", 256).alias("content_sha256"),
    )


def _known_bad(spark, sf):
    """Bodies of documents labelled toxic."""
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select(F.upper(F.sha2("text", 256)).alias("sha256"))


def _gate(spark, sf):
    return gate.gate(_gate_input(spark, sf), _rules(spark), _known_bad(spark, sf)).select(
        "url", "decision.store_content", "decision.blocked", "decision.reason", F.array_join("decision.categories", ",").alias("categories")
    )


def _many_rules(spark, sf):
    """A rule for each part against all documents under twenty repeated urls: every row is judged by its own text and two planted numbers."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("position"), F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string")).alias("category"), F.concat(F.lit(r"\bd"), F.col("p_partkey").cast("string"), F.lit(r"\b")).alias("pattern"))
    rows = texts(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("http://"), "source", F.lit(".onion/")).alias("url"), F.concat(F.coalesce("text", F.lit("")), F.lit(" page d"), (F.col("doc_id") * 3).cast("string"), F.lit(" and D"), (F.col("doc_id") * 5).cast("string"), F.lit(" x")).alias("text"),
        F.lit("text/html").alias("content_type"), F.lit("none").alias("content_sha256"),
    )
    found = gate.gate_by_table(rows, parts, spark.createDataFrame([], "sha256 STRING"))
    return found.select("doc_id", "decision.blocked", F.array_join("decision.categories", ",").alias("categories"))


_GATE_SQL = r"""WITH bad AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
p AS (SELECT 'http://' || source || '.onion/d' || doc_id AS url, 'http://' || source || '.onion/d' || doc_id || chr(10) || text AS hay, doc_id % 10 = 3 AS media, sha256(text) IN (SELECT sha FROM bad) AS bad FROM documents),
m AS (SELECT *, list_filter([CASE WHEN regexp_matches(hay, '(?i)worthless') THEN 'finance' END, CASE WHEN regexp_matches(hay, '(?i)\bthe\s+of\b') THEN 'greeting' END,
  CASE WHEN regexp_matches(hay, '(?i)source17') THEN 'rare' END, CASE WHEN regexp_matches(hay, '(?i)\d{5,}') THEN 'numbers' END], lambda x: x IS NOT NULL) AS hits FROM p)
SELECT url, CASE WHEN bad OR media THEN false ELSE len(hits) = 0 END AS store_content, bad OR (NOT media AND len(hits) > 0) AS blocked,
  CASE WHEN bad THEN 'known-bad-hash' WHEN media THEN 'media' WHEN len(hits) > 0 THEN 'blocklist' END AS reason,
  CASE WHEN bad THEN 'known-bad-hash' WHEN NOT media THEN array_to_string(hits, ',') ELSE '' END AS categories FROM m"""


def html_pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", "url", "html")


def _parsed(spark, sf):
    """Pages with the number of links of their url, which may be stored several times."""
    p = Scratch(spark).cut(parse.parse_pages(html_pages(spark, sf)), "parsed")
    counts = parse.page_links(p).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return p.join(counts, "url", "left").select("page_id", "url", "title", "text", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def _links(spark, sf):
    return parse.page_links(parse.parse_pages(html_pages(spark, sf))).select(
        "url", F.col("position").cast("bigint").alias("position"), "target", "anchor_text", "target_host"
    )


_BODY_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?</head>', ''), '(?s)<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g')"
_UNESCAPE = "regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g')"
PARSED_SQL = rf"""parsed AS (
  SELECT page_id, url, trim({_UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
    array_to_string(list_filter(list_transform(string_split({_BODY_TEXT}, chr(1)), lambda x: regexp_replace({_UNESCAPE.format('x')}, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text,
    regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchors,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages),
hrefs AS (SELECT url, root, host, unnest(range(1, len(hrefs) + 1)) AS i, hrefs, anchors FROM parsed),
links AS (SELECT url, lower(host) AS target_host, {_UNESCAPE.format("root || hrefs[i]")} AS target, trim({_UNESCAPE.format("anchors[i]")}) AS anchor_text,
    row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS position
  FROM (SELECT * FROM hrefs QUALIFY row_number() OVER (PARTITION BY url, hrefs[i] ORDER BY i) = 1))"""


def _annotations(spark, sf):
    """Label table standing in for an outside annotator: one row per labelled document."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("page_url"),
        F.when(F.col("quality") == 1, "forum").otherwise("paste").alias("page_type"),
        F.when(F.col("toxic") == 1, "fraud").otherwise("none").alias("threat_category"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"),
        F.when(F.col("quality") == 1, "en").otherwise("").alias("language"),
        F.array(
            F.struct(F.lit("Handle").alias("type"), F.concat(F.lit(" name"), (F.col("doc_id") % 7).cast("string"), F.lit(" ")).alias("value")),
            F.struct(F.lit("org").alias("type"), F.col("source").alias("value")),
            F.struct(F.lit("wallet").alias("type"), F.lit("x").alias("value")),
            F.struct(F.lit("person").alias("type"), F.lit("  ").alias("value")),
        ).alias("entities"),
    )


def _doc_pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("page_url"), "text", F.col("lang").alias("language")
    )


def _entities(spark, sf):
    return records.annotation_entities(_doc_pages(spark, sf), _annotations(spark, sf)).select("page_url", "ioc_type", "value")


def _annotated_pages(spark, sf):
    return records.annotate_pages(_doc_pages(spark, sf), _annotations(spark, sf)).drop("text")


def _scope(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "://", "://user:pw@"))
        .when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "^http", "ftp"))
        .when(F.col("page_id") % 5 == 2, F.concat("url", F.lit(" x")))
        .when(F.col("page_id") % 5 == 3, F.upper("url"))
        .otherwise(F.col("url"))
        .alias("url"),
    )
    return p.select("page_id", hosts.scope_host(F.col("url")).alias("host"), hosts.hostname(F.col("url")).alias("hostname"))


def _publishable(spark, sf):
    s = F.col("s_suppkey")
    host = (
        F.when(s % 6 == 0, F.concat_ws(".", (s % 256).cast("string"), (s * 7 % 256).cast("string"), (s * 31 % 256).cast("string"), F.lit("9")))
        .when(s % 6 == 1, F.concat(F.lit("shop"), s.cast("string"), F.lit(".onion")))
        .when(s % 6 == 2, F.concat(F.lit("db"), s.cast("string"), F.lit(".internal")))
        .when(s % 6 == 3, F.concat(F.lit("192.168."), (s % 256).cast("string"), F.lit(".1:8080")))
        .when(s % 6 == 4, F.concat(F.lit("LOCALHOST:"), (s + 1).cast("string")))
        .otherwise(F.concat(F.lit("[fe80::"), F.lower(F.hex(s)), F.lit("]:80")))
    )
    return table(spark, sf, "supplier").select("s_suppkey", host.alias("host")).select("s_suppkey", "host", hosts.is_publishable(F.col("host")).alias("publishable"))


QUERIES = {
    "gate_decisions": Query(_gate, _GATE_SQL),
    "gate_many_rules": Query(
        _many_rules,
        # Words by Unicode classes, as word boundaries are; a rule's word is the letter and the number of its part.
        r"""WITH t AS (SELECT doc_id, 'http://' || source || '.onion/' || chr(10) || coalesce(text, '') || ' page d' || (doc_id * 3) || ' and D' || (doc_id * 5) || ' x' AS hay FROM documents),
        w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(hay), '[^\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+'), lambda x: regexp_full_match(x, 'd[0-9]+'))) AS word FROM t),
        m AS (SELECT doc_id, p_partkey FROM w JOIN part ON word = 'd' || p_partkey)
        SELECT doc_id, count(p_partkey) > 0 AS blocked, coalesce(string_agg('c' || p_partkey % 7, ',' ORDER BY p_partkey), '') AS categories FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""",
    ),
    "parsed_pages": Query(_parsed, f"WITH {PARSED_SQL} SELECT page_id, p.url, title, text, (SELECT count(*) FROM links l WHERE l.url = p.url) AS n_links FROM parsed p"),
    "page_links": Query(_links, f"WITH {PARSED_SQL} SELECT url, position, target, anchor_text, target_host FROM links"),
    "scope_hosts": Query(
        _scope,
        r"""SELECT page_id, CASE WHEN page_id % 5 IN (3, 4) THEN h END AS host, h AS hostname FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM pages)""",
    ),
    "publishable_hosts": Query(
        _publishable,
        """WITH h AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey % 256 AS a, s_suppkey * 7 % 256 AS b, s_suppkey * 31 % 256 AS c FROM supplier)
        SELECT s_suppkey, CASE k WHEN 0 THEN a || '.' || b || '.' || c || '.9' WHEN 1 THEN 'shop' || s_suppkey || '.onion' WHEN 2 THEN 'db' || s_suppkey || '.internal'
            WHEN 3 THEN '192.168.' || a || '.1:8080' WHEN 4 THEN 'LOCALHOST:' || (s_suppkey + 1) ELSE '[fe80::' || lower(to_hex(s_suppkey)) || ']:80' END AS host,
          k = 1 OR (k = 0 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
            OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))) AS publishable FROM h""",
    ),
    "indicators": Query(planted_indicators, f"WITH {INDICATORS_SQL} SELECT page_url, ioc_type, value, context FROM indicators"),
    "indicator_counts": Query(
        _indicator_counts, f"WITH {INDICATORS_SQL} SELECT ioc_type, count(*) AS rows, count(DISTINCT value) AS distinct_values FROM indicators GROUP BY ioc_type"
    ),
    "address_checksums": Query(
        _checksums, f"SELECT doc_id, {_ADDR}[doc_id % 4 + 1] AS address, doc_id % 4 < 2 AS valid FROM documents"
    ),
    "credentials": Query(
        lambda spark, sf: records.extract_credentials(planted(spark, sf)),
        f"WITH {CREDENTIALS_SQL} SELECT page_url, email, split_part(email, '@', -1) AS domain, sha256(secret) AS password_sha256 FROM creds",
    ),
    "listings": Query(_listing_prices, f"WITH {LISTINGS_SQL} SELECT page_url, price, currency, product FROM listings"),
    "annotation_entities": Query(
        _entities,
        """WITH a AS (SELECT 'http://' || source || '.onion/d' || doc_id AS page_url, doc_id, source FROM labels JOIN documents USING (doc_id) WHERE length(text) >= 200)
        SELECT page_url, 'handle_llm' AS ioc_type, 'name' || (doc_id % 7) AS value FROM a UNION ALL SELECT page_url, 'org', source FROM a""",
    ),
    "annotated_pages": Query(
        _annotated_pages,
        """SELECT 'http://' || source || '.onion/d' || d.doc_id AS page_url, CASE WHEN g THEN CASE WHEN quality = 1 THEN 'forum' ELSE 'paste' END END AS page_type,
          CASE WHEN g THEN CASE WHEN toxic = 1 THEN 'fraud' ELSE 'none' END END AS threat_category, CASE WHEN g THEN 'quality ' || quality END AS summary,
          CASE WHEN g AND quality = 1 THEN 'en' ELSE lang END AS language
        FROM (SELECT *, length(text) >= 200 AS long FROM documents) d LEFT JOIN labels l USING (doc_id), LATERAL (SELECT d.long AND l.doc_id IS NOT NULL AS g)""",
    ),
}
