"""Queries over exports: STIX objects, evidence manifests, case chronology, host packs and extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_micros
from ..operators import clusters, evaluate, evidence, records, stix
from ..operators.indicators import extract_indicators
from . import Query
from .extract import CREDENTIALS_SQL, INDICATORS_SQL, LISTINGS_SQL, PLANTED_SQL, planted, planted_indicators, planted_listings
from .graph import CLUSTERS_SQL, order_identifiers
from .inputs import table
from .lookup import stored_documents

PRODUCER = "tidelog"
STAMP = "2024-05-06 07:08:09"


def _sightings(spark, sf):
    return planted_indicators(spark, sf).withColumn("created_at", F.lit(STAMP).cast("timestamp"))


def _uuid5_sql(seed: str) -> str:
    """UUIDv5 of a SQL string expression under the STIX namespace."""
    h = f"sha1(unhex('{stix.STIX_NAMESPACE.replace('-', '')}') || CAST(encode({seed}) AS BLOB))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', (CAST(('0x' || substr({h}, 17, 1)) AS INT) % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


_PATHS = "CASE ioc_type " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p, _ in stix.PATTERNS) + " END"
_LABELS = "CASE ioc_type " + " ".join(f"WHEN '{k}' THEN '{la}'" for k, _, la in stix.PATTERNS) + " END"


def _get(path):
    return F.get_json_object("object", f"$.{path}")


def _stix_indicators(spark, sf):
    o = stix.indicator_objects(_sightings(spark, sf), PRODUCER)
    return o.select("id", _get("name").alias("name"), _get("pattern").alias("pattern"), _get("indicator_types[0]").alias("label"), _get("description").alias("description"), _get("valid_from").alias("valid_from"))


def _stix_vulnerabilities(spark, sf):
    o = stix.vulnerability_objects(_sightings(spark, sf), PRODUCER)
    return o.select("id", _get("name").alias("name"), _get("external_references[0].external_id").alias("external_id"))


def _attributed(spark, sf):
    created = F.lit(STAMP).cast("timestamp")
    carried = {"target_ref": stix.actor_reference(), "created_at": created}
    firsts, a, m = clusters.attributed(order_identifiers(spark, sf).withColumn("created_at", created), carried)
    return firsts, a.withColumn("created_at", created), m


def _stix_actors(spark, sf):
    _, a, _ = _attributed(spark, sf)
    return stix.actor_objects(a, PRODUCER).select("id", _get("name").alias("name"), _get("description").alias("description"))


def _stix_relationships(spark, sf):
    _, _, m = _attributed(spark, sf)
    r = stix.attribution_relationships(m, PRODUCER)
    return r.groupBy("target_ref").agg(F.count(F.lit(1)).alias("indicators"), F.min("source_ref").alias("first_source"))


def _stix_bundle(spark, sf):
    """Counts of all attribution objects, each different id once."""
    return stix.object_counts(stix.attribution_objects(*_attributed(spark, sf), PRODUCER))


def _bundle_id(spark, sf):
    """Id of a bundle of all vulnerability objects: one object for a CVE number, of which there are at most nine thousand."""
    return stix.bundle_id(stix.vulnerability_objects(_sightings(spark, sf), PRODUCER))


def _armoured(spark, sf):
    """Pages with a version 4 key in armour, old and new packet headers by turns; every fifth key is of another version."""
    n = F.col("doc_id")
    body = F.concat(F.when(n % 5 == 4, "03").otherwise("04"), F.lpad(F.hex(n), 8, "0"), F.lit("01"), F.sha2(F.concat(F.lit("key"), n.cast("string")), 256))
    size = F.lpad(F.hex((F.length(body) / 2).cast("bigint")), 2, "0")
    packet = F.when(n % 2 == 0, F.concat(F.lit("9900"), size, body)).otherwise(F.concat(F.lit("C6"), size, body))
    armour = F.concat(F.lit("-----BEGIN PGP PUBLIC KEY BLOCK-----\nVersion: x 1\n\n"), F.base64(F.unhex(packet)), F.lit("\n=abcd\n-----END PGP PUBLIC KEY BLOCK-----\n"))
    pages = table(spark, sf, "documents").select(n.cast("string").alias("page_url"), F.concat(F.lit("mine:\n"), armour, F.when(n % 7 == 0, armour).otherwise("")).alias("text"))
    return extract_indicators(pages).select(F.col("page_url").cast("bigint").alias("doc_id"), "ioc_type", "value")


def _members(spark, sf):
    """Files of the manifest above against the documents that have a body: what only one of the two names."""
    listed = evidence.artefacts(_captured(spark, sf)).filter(F.col("name").endswith(".body")).select("name")
    n = F.col("doc_id")
    url = F.concat(F.lit("http://"), "source", F.lit(".onion/d"), n.cast("string"))
    wanted = table(spark, sf, "documents").filter((n % 3 != 0) & (n % 2 == 0)).select(F.concat(F.lit("pages/"), F.sha2(url, 256), F.lit(".body")).alias("name"))
    return evidence.same_members(listed, wanted)


def _captured(spark, sf):
    """Stored documents with their bodies: every third has no body, every seventh body was altered."""
    n = F.regexp_extract("title", "([0-9]+)", 1).cast("bigint")
    return stored_documents(spark, sf).withColumns(
        {
            "html": F.when(n % 2 == 0, F.concat(F.lit("<p>"), "content", F.lit("</p>"))),
            "raw_body": F.when(n % 3 != 0, F.encode(F.when(n % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), "UTF-8")),
            "body_truncated": F.when(n % 5 == 0, True).when(n % 5 != 1, False),
            "fetched_at": F.col("content_captured_at"),
            "content_captured_at": F.when(n % 4 != 0, F.col("content_captured_at")),
        }
    )


CAPTURED_SQL = INDICATORS_SQL + """,
cap AS (SELECT page_url AS url, doc_id, text, doc_id % 17 = 0 AS blocked, doc_id % 3 <> 0 AS has_body, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS verified,
  CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 <> 1 THEN false END AS truncated FROM planted),
mani AS (SELECT url, CASE WHEN doc_id % 4 <> 0 THEN 'successful_capture' ELSE 'legacy_last_fetch_unverified' END AS timestamp_source, 'pages/' || sha256(url) || '.txt' AS text_file, sha256(text) AS text_sha256,
  CASE WHEN doc_id % 2 = 0 THEN 'pages/' || sha256(url) || '.html' END AS html_file, CASE WHEN doc_id % 2 = 0 THEN sha256('<p>' || text || '</p>') END AS html_sha256,
  CASE WHEN has_body THEN 'pages/' || sha256(url) || '.body' END AS body_file, verified AS body_verifiable, verified AND coalesce(NOT truncated, false) AS complete_body_verifiable FROM cap WHERE NOT blocked)"""


def _manifest(spark, sf):
    m = evidence.manifest(_captured(spark, sf), planted_indicators(spark, sf))
    return m.select(
        "url", "timestamp_source", "text_file", "text_sha256", "html_file", "html_sha256", "body_file", "body_verifiable", "complete_body_verifiable",
        F.coalesce(F.size("indicators"), F.lit(0)).cast("bigint").alias("n_indicators"),
    )


def _versioned(spark, sf):
    """Three versions of every stored document: the first two intact, the body of the third altered after its hash was taken."""
    v = F.col("version_id")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("http://"), "source", F.lit(".onion/d"), F.col("doc_id").cast("string")).alias("url"), "text", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("version_id"))
    content = F.concat("text", F.lit(" v"), v.cast("string"))
    return d.select(
        "url", F.lit(None).cast("string").alias("title"), content.alias("content"), F.lit(None).cast("string").alias("html"), F.encode(F.when(v == 2, F.concat(content, F.lit("!"))).otherwise(content), "UTF-8").alias("raw_body"),
        F.sha2(content, 256).alias("content_sha256"), F.lit(False).alias("body_truncated"), F.lit(None).cast("timestamp").alias("content_captured_at"), F.lit(None).cast("timestamp").alias("fetched_at"),
        v, (v == 0).alias("legacy"), F.concat(F.lit('{"agent": "a'), v.cast("string"), F.lit('"}')).alias("capture_metadata"),
    )


def _historical(spark, sf):
    pages = _versioned(spark, sf)
    rows, members = evidence.manifest(pages, historical=True), evidence.artefacts(pages, historical=True)
    bad = evidence.verify_manifest(rows, members, evidence.checksums(members)).select(F.col("name").alias("body_file"), "problem")
    shown = rows.select("url", "version_id", "hostname", "legacy", F.col("collector")["agent"].alias("agent"), "body_file", "text_sha256", "body_verifiable")
    return shown.join(bad, "body_file", "left")


def _verified(spark, sf):
    """Verification of the manifest above: the altered bodies are the violations."""
    pages = _captured(spark, sf)
    members = evidence.artefacts(pages)
    return evidence.verify_manifest(evidence.manifest(pages), members, evidence.checksums(members))


def _case_items(spark, sf):
    """Labels as case items; toxic ones cite a capture that retention removed."""
    return table(spark, sf, "labels").select(
        (F.col("doc_id") % 5).alias("case_id"), F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("version_id"),
        F.concat(F.lit("http://secret.onion/d"), F.col("doc_id").cast("string")).alias("page_url"), F.lit("relevant").alias("verdict"), F.concat(F.lit("note of secret "), F.col("doc_id").cast("string")).alias("notes"),
    )


def _doc_version_rows(spark, sf):
    return stored_documents(spark, sf).select(
        F.regexp_extract("title", "([0-9]+)", 1).cast("bigint").alias("version_id"), "url", F.col("content_captured_at").alias("captured_at"), "title", "content", F.col("content_sha256").alias("body_sha256"), "body_truncated"
    )


def _chronology(spark, sf):
    c = evidence.chronology(_case_items(spark, sf), _doc_version_rows(spark, sf), ["secret", "the", "secret.onion"])
    return c.select("case_id", "item_id", "available", "source", "interpretation", F.sha2("excerpt", 256).alias("excerpt_sha256"), iso_micros(F.col("captured_at")).alias("captured_at"))


def _host_state(spark, sf):
    s = stored_documents(spark, sf)
    n = F.regexp_extract("title", "([0-9]+)", 1).cast("bigint")
    return s.withColumns(
        {
            "status": F.when(n % 9 == 0, "dead").otherwise("crawled"),
            "fetched_at": F.col("content_captured_at"),
            # Hosts whose source number is a multiple of seven are local fixtures.
            "hostname": F.when(F.regexp_extract("hostname", "([0-9]+)", 1).cast("int") % 7 == 0, F.concat(F.lit("10.0.0."), F.regexp_extract("hostname", "([0-9]+)", 1))).otherwise(F.col("hostname")),
        }
    )


def _packs(spark, sf):
    # Hosts differ by what is planted: those whose source number leaves 1 over 3 offer without a price.  Every listing counts.
    listings = planted_listings(spark, sf, F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int") % 3 != 1, F.lit(True)))
    e = evaluate.host_evidence(_host_state(spark, sf), listings, planted_indicators(spark, sf))
    return evaluate.host_packs(e, min_pages=45).select("pack", "hostname", "url", "note", "last_seen", "evidence")


def _metrics(spark, sf):
    """Predicted strong identifiers against the planted ones."""
    predicted = planted_indicators(spark, sf).filter(F.col("ioc_type").isin("handle", "jabber", "contact_email", "btc")).select("page_url", "ioc_type", "value")
    p = planted(spark, sf)
    n = F.col("doc_id")
    gold = p.select(
        "page_url",
        F.explode(
            F.array(
                F.struct(F.lit("handle").alias("ioc_type"), F.concat(F.lit("seller"), (n % 97).cast("string")).alias("value")),
                F.struct(F.lit("jabber").alias("ioc_type"), F.concat(F.lit("im"), (n % 30).cast("string"), F.lit("@exploit.im")).alias("value")),
                F.struct(F.lit("contact_email").alias("ioc_type"), F.concat(F.lit("ops"), (n % 53).cast("string"), F.lit("@proton.me")).alias("value")),
            )
        ).alias("g"),
    ).select("page_url", "g.ioc_type", "g.value")
    m = evaluate.set_metrics(predicted, gold, ["page_url", "ioc_type", "value"], ["ioc_type"])
    return m.select("ioc_type", "true_positive", "false_positive", "false_negative", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


GOLD_SQL = INDICATORS_SQL + """,
gold AS (SELECT page_url, 'handle' AS ioc_type, 'seller' || (doc_id % 97) AS value FROM planted UNION ALL SELECT page_url, 'jabber', 'im' || (doc_id % 30) || '@exploit.im' FROM planted UNION ALL SELECT page_url, 'contact_email', 'ops' || (doc_id % 53) || '@proton.me' FROM planted),
pred AS (SELECT page_url, ioc_type, value FROM indicators WHERE ioc_type IN ('handle', 'jabber', 'contact_email', 'btc'))"""


def _errors(spark, sf):
    predicted = planted_indicators(spark, sf).filter(F.col("ioc_type") == "jabber").select("page_url", "value")
    gold = planted(spark, sf).select("page_url", F.concat(F.lit("im"), (F.col("doc_id") % 30).cast("string"), F.lit("@exploit.im")).alias("value"))
    return evaluate.errors(predicted, gold, ["page_url", "value"])


def _feedback(spark, sf):
    """Reviewed handles: confirmed ones must still be found, one in three was called a false positive."""
    p = planted(spark, sf)
    return p.select(
        F.col("doc_id").alias("review_id"), F.col("doc_id").alias("version_id"), F.lit("iocs").alias("extractor"), F.concat(F.lit("seller"), (F.col("doc_id") % 89).cast("string")).alias("value"),
        F.when(F.col("doc_id") % 3 == 0, "false_positive").otherwise("confirmed").alias("verdict"), F.lit("checked").alias("reason"),
    )


def _reviewed(spark, sf):
    examples = _feedback(spark, sf).withColumnRenamed("value", "expected")
    texts = planted(spark, sf).select(F.col("doc_id").alias("review_id"), "text").withColumn("page_url", F.col("review_id").cast("string"))
    found = extract_indicators(texts).select(F.col("page_url").cast("bigint").alias("review_id"), "value")
    return evaluate.pass_rate(evaluate.review_outcomes(examples, found))


def _regression(spark, sf):
    e = evaluate.regression_examples(_feedback(spark, sf), _doc_version_rows(spark, sf).drop("url"))
    return e.select("review_id", "expected", "verdict", F.sha2("text", 256).alias("text_sha256"), "body_sha256")


def _reprocessed(spark, sf):
    """Stored credentials after a pass that failed on every fourth page: those keep their old rows."""
    fresh = records.extract_credentials(planted(spark, sf))
    stored = planted(spark, sf).select("page_url", F.lit("old@corp.example").alias("email"), F.lit("corp.example").alias("domain"), F.sha2("page_url", 256).alias("password_sha256"))
    done = planted(spark, sf).select("page_url", F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(F.lit("credentials").alias("extractor"), F.lit("ValueError").alias("error_type")))).alias("errors"))
    return records.replace_derived(stored, fresh, done, "credentials").select("page_url", "email", "domain")


QUERIES = {
    "stix_indicators": Query(
        _stix_indicators,
        f"""WITH {INDICATORS_SQL}, f AS (SELECT ioc_type, value, min(page_url) AS page_url FROM indicators WHERE ioc_type IN ({", ".join(repr(k) for k, _, _ in stix.PATTERNS)}) GROUP BY ALL)
        SELECT 'indicator--' || {_uuid5_sql("ioc_type || ':' || value")} AS id, ioc_type || ': ' || substr(value, 1, 80) AS name, '[' || {_PATHS} || ' = ''' || value || ''']' AS pattern, {_LABELS} AS label,
          'Observed on ' || page_url AS description, '2024-05-06T07:08:09.000Z' AS valid_from FROM f""",
    ),
    "stix_vulnerabilities": Query(
        _stix_vulnerabilities,
        f"""WITH {INDICATORS_SQL} SELECT DISTINCT 'vulnerability--' || {_uuid5_sql("'cve:' || upper(value)")} AS id, upper(value) AS name, upper(value) AS external_id FROM indicators WHERE ioc_type = 'cve'""",
    ),
    "stix_actors": Query(
        _stix_actors,
        f"""WITH {CLUSTERS_SQL} SELECT 'threat-actor--' || {_uuid5_sql("'actor:' || substr(cluster, 1, 70)")} AS id, substr(cluster, 1, 70) AS name,
          'Cluster of ' || identifiers || ' reused identifier(s) observed across ' || page_count || ' page(s). Inferred co-occurrence cluster, not verified identity.' AS description FROM actors""",
    ),
    "stix_relationships": Query(
        _stix_relationships,
        f"""WITH {CLUSTERS_SQL} SELECT 'threat-actor--' || {_uuid5_sql("'actor:' || substr(cluster, 1, 70)")} AS target_ref, count(*) AS indicators, min('indicator--' || {_uuid5_sql("ioc_type || ':' || value")}) AS first_source
        FROM actors JOIN clusters USING (cluster) GROUP BY cluster""",
    ),
    "stix_bundle_id": Query(
        _bundle_id,
        f"""WITH {INDICATORS_SQL}, v AS (SELECT DISTINCT 'vulnerability--' || {_uuid5_sql("'cve:' || upper(value)")} AS id FROM indicators WHERE ioc_type = 'cve'),
        j AS (SELECT count(*) AS n, string_agg(id, ';' ORDER BY id) AS ids FROM v) SELECT n, 'bundle--' || {_uuid5_sql("ids")} AS id FROM j""",
    ),
    "armoured_keys": Query(
        _armoured,
        """WITH k AS (SELECT doc_id, '04' || lpad(upper(to_hex(doc_id)), 8, '0') || '01' || sha256('key' || doc_id) AS body FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'pgp' ELSE 'pgp_fp' END AS ioc_type, CASE WHEN doc_id % 5 = 4 THEN 'present' ELSE upper(sha1(unhex('9900' || upper(to_hex(length(body) // 2)) || body))) END AS value FROM k""",
    ),
    "manifest_members": Query(
        _members,
        f"""WITH {CAPTURED_SQL}, l AS (SELECT 'pages/' || sha256(url) || '.body' AS name FROM cap WHERE NOT blocked AND has_body),
        w AS (SELECT 'pages/' || sha256('http://' || source || '.onion/d' || doc_id) || '.body' AS name FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0)
        SELECT name, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM w) UNION ALL SELECT name, 'right' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM l)""",
    ),
    "stix_bundle": Query(
        _stix_bundle,
        f"""WITH {CLUSTERS_SQL} SELECT 'identity' AS type, count(DISTINCT 1) AS objects, count(DISTINCT 1) AS ids FROM orders
        UNION ALL SELECT 'indicator', count(*), count(*) FROM (SELECT DISTINCT ioc_type, value FROM ids) UNION ALL SELECT 'threat-actor', count(*), count(*) FROM actors
        UNION ALL SELECT 'relationship', count(*), count(*) FROM actors JOIN clusters USING (cluster)""",
    ),
    "evidence_manifest": Query(
        _manifest,
        f"""WITH {CAPTURED_SQL}, ni AS (SELECT page_url AS url, count(*) AS n FROM indicators GROUP BY 1) SELECT mani.*, coalesce(n, 0) AS n_indicators FROM mani LEFT JOIN ni USING (url)""",
    ),
    "historical_manifest": Query(
        _historical,
        """WITH v AS (SELECT doc_id, source, 'http://' || source || '.onion/d' || doc_id AS url, text || ' v' || k AS content, CAST(k AS INTEGER) AS version_id FROM documents, range(3) r(k))
        SELECT 'pages/' || sha256(url || ' ' || version_id) || '.body' AS body_file, url, version_id, source || '.onion' AS hostname, version_id = 0 AS legacy, 'a' || version_id AS agent, sha256(content) AS text_sha256,
          version_id <> 2 AS body_verifiable, CASE WHEN version_id = 2 THEN 'body does not match the manifest' END AS problem FROM v""",
    ),
    "evidence_violations": Query(
        _verified,
        f"""WITH {CAPTURED_SQL} SELECT 'pages/' || sha256(url) || '.body' AS name, 'body does not match the manifest' AS problem FROM cap WHERE NOT blocked AND has_body AND NOT verified""",
    ),
    "case_chronology": Query(
        _chronology,
        f"""WITH {PLANTED_SQL} SELECT l.doc_id % 5 AS case_id, l.doc_id AS item_id, toxic = 0 AS available, 'http://[REDACTED]/d' || l.doc_id AS source, 'note of [REDACTED] ' || l.doc_id AS interpretation,
          sha256(CASE WHEN toxic = 0 THEN replace(replace(p.text, 'secret', '[REDACTED]'), 'the', '[REDACTED]') ELSE '' END) AS excerpt_sha256,
          CASE WHEN toxic = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(l.doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S.%f') END AS captured_at FROM labels l JOIN planted p USING (doc_id)""",
    ),
    "host_packs": Query(
        _packs,
        f"""WITH {INDICATORS_SQL},
        priced AS (SELECT page_url, CASE WHEN coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 3 <> 1, true) THEN p.text
          ELSE replace(p.text, ' only $' || (doc_id % 500 + 1) || '.50 today ', ' on request ') END AS text FROM planted p JOIN documents USING (doc_id)),
        {LISTINGS_SQL[len(PLANTED_SQL) + 2 :].replace("FROM planted", "FROM priced")},
        hs AS (SELECT page_url, doc_id, regexp_extract(page_url, '^http://([^/]*)', 1) AS hostname, doc_id % 9 <> 0 AS crawled FROM planted),
        pl AS (SELECT page_url, count(*) AS l FROM listings GROUP BY 1), pi AS (SELECT page_url, count(*) AS i FROM indicators WHERE ioc_type IN ('btc', 'eth', 'xmr', 'handle', 'pgp_fp', 'contact_email', 'jabber') GROUP BY 1),
        ev AS (SELECT hostname, count(*) FILTER (crawled) AS pages, CAST(coalesce(sum(l), 0) AS BIGINT) AS listings, CAST(coalesce(sum(i), 0) AS BIGINT) AS identifiers, min('Report ' || doc_id) FILTER (crawled) AS note,
          strftime(max(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER))) FILTER (crawled), '%Y-%m-%d') AS last_seen FROM hs LEFT JOIN pl USING (page_url) LEFT JOIN pi USING (page_url) GROUP BY hostname),
        ok AS (SELECT * FROM ev WHERE pages > 0 AND CAST(regexp_extract(hostname, '([0-9]+)', 1) AS INT) % 7 <> 0)
        SELECT 'commerce' AS pack, hostname, 'http://' || hostname || '/' AS url, note, last_seen, listings || ' listing(s) extracted' AS evidence FROM ok WHERE listings >= 3
        UNION ALL SELECT 'actor-infrastructure', hostname, 'http://' || hostname || '/', note, last_seen, identifiers || ' actor identifier(s) extracted' FROM ok WHERE identifiers >= 2 AND listings < 3
        UNION ALL SELECT 'verified-live', hostname, 'http://' || hostname || '/', note, last_seen, pages || ' page(s) fetched successfully' FROM ok WHERE pages >= 45""",
    ),
    "extraction_metrics": Query(
        _metrics,
        f"""WITH {GOLD_SQL}, b AS (SELECT coalesce(p.ioc_type, g.ioc_type) AS ioc_type, p.page_url IS NOT NULL AS p, g.page_url IS NOT NULL AS g FROM pred p FULL JOIN gold g ON p.page_url = g.page_url AND p.ioc_type = g.ioc_type AND p.value = g.value)
        SELECT ioc_type, count(*) FILTER (p AND g) AS true_positive, count(*) FILTER (p AND NOT g) AS false_positive, count(*) FILTER (g AND NOT p) AS false_negative,
          round(count(*) FILTER (p AND g) / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND g) / nullif(count(*) FILTER (g), 0), 6) AS recall FROM b GROUP BY ioc_type""",
    ),
    "extraction_errors": Query(
        _errors,
        f"""WITH {GOLD_SQL}, p AS (SELECT page_url, value FROM pred WHERE ioc_type = 'jabber'), g AS (SELECT page_url, value FROM gold WHERE ioc_type = 'jabber')
        SELECT *, 'false_positive' AS error FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT *, 'false_negative' FROM (SELECT * FROM g EXCEPT SELECT * FROM p)""",
    ),
    "review_pass_rate": Query(
        _reviewed,
        f"""WITH {INDICATORS_SQL}, e AS (SELECT doc_id % 3 = 0 AS fp, EXISTS (SELECT 1 FROM indicators i WHERE i.page_url = p.page_url AND i.value = 'seller' || (p.doc_id % 89)) AS found FROM planted p)
        SELECT count(*) AS total, count(*) FILTER (found <> fp) AS passed FROM e""",
    ),
    "regression_examples": Query(
        _regression,
        f"""WITH {PLANTED_SQL} SELECT doc_id AS review_id, 'seller' || (doc_id % 89) AS expected, CASE WHEN doc_id % 3 = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict, sha256(text) AS text_sha256, sha256(text) AS body_sha256
        FROM planted""",
    ),
    "reprocessed_credentials": Query(
        _reprocessed,
        f"""WITH {CREDENTIALS_SQL} SELECT page_url, email, split_part(email, '@', -1) AS domain FROM creds JOIN planted USING (page_url) WHERE doc_id % 4 <> 0
        UNION ALL SELECT page_url, 'old@corp.example', 'corp.example' FROM planted WHERE doc_id % 4 = 0""",
    ),
}
