import datetime as dt
import hashlib
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions.hosts import hostname, is_onion, is_publishable, scope_host
from tidelog.functions.text import event_watch_host, event_watch_kind, humanize, redact, same_words
from tidelog.operators import alerts as al
from tidelog.operators import evaluate, evidence, frontier, history, search, stix
from tidelog.schemas import VERSIONS, WATCHLISTS
from tidelog.sources import readers, writers

NOW = dt.datetime(2024, 5, 1, 12)


def column(spark, values, build, schema="v STRING"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


# --- hosts and text ---


def test_publishable_hosts_agree_with_the_address_rules(spark):
    literals = ["127.0.0.1", "10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "224.0.0.1", "255.255.255.255", "169.254.1.1", "100.64.0.1", "198.18.0.1", "203.0.113.9",
                "::1", "::", "fe80::1", "fc00::1", "ff02::1", "2606:4700::1111", "2001:db8::1", "2a00:1450:4001::8"]

    def rule(v):
        a = ipaddress.ip_address(v)
        return not (a.is_loopback or a.is_private or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)

    assert column(spark, literals, is_publishable) == [rule(v) for v in literals]
    names = ["shop.onion", "localhost", "a.local", "B.INTERNAL", "x.test", "", " ", "127.0.0.1:8000", "[::1]:80", "shop.onion:80", "localhost.localdomain"]
    assert column(spark, names, is_publishable) == [True, False, False, False, False, False, False, False, False, True, False]


def test_hosts(spark):
    urls = ["http://User@Ab.Onion:80/x", "https://[::1]:8/y", "nope", "http:///p"]
    assert column(spark, urls, hostname) == ["ab.onion", "::1", "", ""]
    assert column(spark, urls[:2], is_onion) == [True, False]
    good = ["http://Ab.Onion./x", "http://a.onion:80/", "http://u:p@a.onion/", "ftp://a.onion/", "http://a b.onion/", "http://a.onion:99999/", "http://a.onion/" + "x" * 2100, "http:///x"]
    assert column(spark, good, scope_host) == ["ab.onion", "a.onion"] + [None] * 6


def test_idna_hosts(spark):
    df = spark.createDataFrame([("bücher.example",), ("Plain.example",)], "hostname STRING")
    assert sorted(r["ascii_host"] for r in frontier.idna_hosts(df).collect()) == ["plain.example", "xn--bcher-kva.example"]


def test_small_text_functions(spark):
    assert column(spark, [5.9, 89.0, 90.0, 5399.0, 5400.0, 94320.0, 172800.0], humanize, "v DOUBLE") == [
        "5 second(s)", "89 second(s)", "2 minute(s)", "90 minute(s)", "1.5 hour(s)", "26.2 hour(s)", "2.0 day(s)",
    ]
    assert column(spark, ["my secret.onion is secret"], lambda c: redact(c, ["secret", "secret.onion"])) == ["my [REDACTED] is [REDACTED]"]
    assert column(spark, ["a \n b c "], lambda c: same_words(c, F.lit("a b c"))) == [True]
    values = ["page_dead@x.onion", "@x.onion", "notable", " page_new @ a@b "]
    assert column(spark, values, event_watch_kind) == ["page_dead", "notable", "notable", "page_new"]
    assert column(spark, values, event_watch_host) == ["x.onion", "x.onion", None, "a@b"]


# --- search ---


def stored(spark):
    rows = [("u1", "Shop", "contact seller now", "h.onion", False, NOW, "a"), ("u2", "x", "Contact  seller login", "h.onion", False, NOW, "b"),
            ("u3", None, "please contact seller", "g.onion", False, NOW - dt.timedelta(days=3), "c"), ("u4", "x", "contact seller", "h.onion", True, NOW, "d")]
    return spark.createDataFrame(rows, "url STRING, title STRING, content STRING, hostname STRING, blocked BOOLEAN, content_captured_at TIMESTAMP, content_sha256 STRING")


def test_text_search(spark):
    ids = spark.createDataFrame([("u3", "btc", "w")], "page_url STRING, ioc_type STRING, value STRING")

    def urls(q, **kw):
        return sorted(r["url"] for r in search.text_search(stored(spark), ids, q, **kw).collect())

    assert urls('"contact seller" -login') == ["u1", "u3"]
    assert urls('"contact seller"', engine="phrase") == ["u1", "u2", "u3"]
    assert urls("contact", kind="btc") == ["u3"] and urls("contact", host="G.onion") == ["u3"]
    assert urls("contact", since=NOW.date()) == ["u1", "u2"] and urls("contact", until=NOW.date()) == ["u1", "u2", "u3"]
    with pytest.raises(ValueError):
        urls("x", since=dt.date(2024, 2, 2), until=dt.date(2024, 2, 1))
    with pytest.raises(ValueError):
        urls('"open')
    with pytest.raises(ValueError):
        urls(" ".join(map(str, range(31))))
    index = search.token_index(stored(spark))
    assert sorted(r["url"] for r in search.phrase_lookup(index, "Contact seller").collect()) == ["u1", "u2", "u3"]
    assert search.phrase_lookup(index, "seller contact").count() == 0


def test_snippet_starts_before_the_first_hit(spark):
    text = "x" * 200 + "Needle" + "y" * 700
    assert column(spark, [text], lambda c: search.snippet(c, ["zzz", "needle"])) == [text[110:710]]
    assert column(spark, [text], lambda c: search.snippet(c, [])) == [text[:600]]


def test_vector_search_ties_and_bad_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", None)]
    v = spark.createDataFrame(rows, "page_url STRING, vector ARRAY<FLOAT>").repartition(3)
    got = search.dense_search(v, [("q", [1.0, 0.0]), ("r", [0.0, 1.0])], 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["page_url"]) for r in got] == [("q", "b"), ("q", "a"), ("r", "c"), ("r", "b")]


def test_hashed_search_needs_the_same_model(spark):
    p = stored(spark)
    v = search.embed_pages(p, 64).withColumn("model", F.when(F.col("page_url") == "u3", "other-64").otherwise(F.col("model")))
    assert [r["url"] for r in search.hashed_search(p, v, "contact seller now", 64, 5).collect()][0] == "u1"
    assert "u3" not in [r["url"] for r in search.hashed_search(p, v, "contact", 64, 5).collect()]
    assert search.hashed_search(p, v, "  ", 64, 5).count() == 0


# --- frontier ---


def test_structural_prior(spark):
    urls = ["http://h/login.php", "http://h/shop/login", "http://h/vendor/x", "http://h/cat?id=1", "http://h/blogin", "http://h/style.css", "http://h/plain"]
    assert column(spark, urls, frontier.structural_prior) == [0.05, 0.05, 2.0, 2.0, 1.0, 0.05, 1.0]


def test_scores_demote_off_host_links_of_targeted_lineages(spark):
    links = spark.createDataFrame([("http://pin.onion/a", "x", True), ("http://far.onion/a", "x", True), ("http://far.onion/b", "Drug x", False)], "url STRING, anchor_text STRING, targeted BOOLEAN")
    pins = spark.createDataFrame([("pin.onion",)], "hostname STRING")
    out = frontier.score_links(links, pins, frontier.keyword_score(F.col("anchor_text"), F.col("url"), ["drug"]))
    assert {r["url"]: round(r["score"], 6) for r in out.collect()} == {"http://pin.onion/a": 1.0, "http://far.onion/a": 0.1, "http://far.onion/b": 2.0}


def test_focus_centroid_prefers_shared_words(spark):
    links = spark.createDataFrame([("buy blue notebooks", "http://h/x"), ("garden", "http://h/y")], "anchor STRING, url STRING")
    score = frontier.centroid_score(F.col("anchor"), F.col("url"), search.focus_centroid(["blue notebooks", "notebooks"], 512), 512)
    a, b = [r[0] for r in links.select(score).collect()]
    assert a > 1.3 and b == 1.0


def test_admission_counts_known_pages(spark):
    known = spark.createDataFrame([("http://a.onion/0", "a.onion", False), ("http://p.onion/0", "p.onion", True)], "url STRING, hostname STRING, pinned BOOLEAN")
    rows = [(f"http://{h}.onion/{i}", "par", 1, 1.0, False, i) for h in "apz" for i in range(6)] + [("http://a.onion/1", "later", 1, 9.0, False, 99), ("http://z.onion/deep", "x", 9, 1.0, False, 0)]
    new = frontier.admit(spark.createDataFrame(rows, "url STRING, parent_url STRING, depth INT, score DOUBLE, targeted BOOLEAN, position INT"), known, 2, 4)
    got = {}
    for r in new.collect():
        got.setdefault(r["hostname"], []).append(r["url"][-1])
    assert {h: sorted(v) for h, v in got.items()} == {"a.onion": ["1"], "p.onion": ["1", "2", "3"], "z.onion": ["0", "1"]}
    assert frontier.admit(spark.createDataFrame(rows, "url STRING, parent_url STRING, depth INT, score DOUBLE, targeted BOOLEAN, position INT"), known, 0, 0).count() == 16
    one = frontier.admit(spark.createDataFrame(rows, "url STRING, parent_url STRING, depth INT, score DOUBLE, targeted BOOLEAN, position INT"), known, 0, 3)
    assert {r["hostname"]: r["n"] for r in one.groupBy("hostname").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a.onion": 5, "p.onion": 2, "z.onion": 6}


def test_idn_hosts_are_discovered_and_admitted(spark):
    links = spark.createDataFrame([("http://b\u00fccher.example/a", 1), ("http://plain.example/a", 2), ("http://\u00fc..x/", 3), (None, 4)], "url STRING, position INT")
    links = links.select("url", F.lit("p").alias("parent_url"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.lit(False).alias("targeted"), "position")
    found = frontier.discovered(links, allow_clearnet=True)
    assert found.count() == 2
    known = spark.createDataFrame([], "url STRING, hostname STRING, pinned BOOLEAN")
    assert {r["hostname"] for r in frontier.admit(found, known).collect()} == {"xn--bcher-kva.example", "plain.example"}
    assert frontier.discovered(links, allow_clearnet=True, allowed_hosts=["xn--bcher-kva.example"]).count() == 1


# --- alerts ---

EVENTS = "event_id BIGINT, occurred_at TIMESTAMP, kind STRING, hostname STRING, page_url STRING, summary STRING, detail STRING"
NONE_PRIOR = "watchlist_id BIGINT, page_url STRING, dedup_key STRING"


def test_event_alerts(spark):
    at = [NOW + dt.timedelta(minutes=i) for i in range(6)]
    events = spark.createDataFrame(
        [(1, at[0], "page_new", "h", "p", "new", None), (2, at[1], "page_unreachable", "h", "p", "down", None), (3, at[2], "page_recovered", "h", "p", "up", None),
         (4, at[3], "page_unreachable", "g", "q", "down2", None), (5, at[4], "page_changed", "h", "p", "chg", None), (6, at[5], "page_changed", "g", "q", "chg2", None)], EVENTS)
    versions = spark.createDataFrame(
        [(1, "p", at[0], "t", "a b", None, "x", False, False), (2, "p", at[4], "t", "a \n b", None, "y", False, False), (3, "q", at[5], "t", "only", None, "z", False, False)], VERSIONS)
    lists = spark.createDataFrame(
        [(1, "n", "event", "notable", None, True), (2, "s", "event", "page_unreachable@g", None, True), (3, "c", "event", "page_changed", None, True), (4, "off", "event", "notable", None, False)], WATCHLISTS)
    none = spark.createDataFrame([], NONE_PRIOR)
    got = al.event_alerts(lists, events, versions, none)
    assert sorted((r["watchlist_id"], r["event_id"]) for r in got.collect()) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 6)]
    assert al.event_alerts(lists, events, versions, got).count() == 0
    capped = al.event_alerts(lists, events, versions, none, per_list=1)
    assert sorted((r["watchlist_id"], r["event_id"]) for r in capped.collect()) == [(1, 4), (2, 4), (3, 6)]


def test_content_alerts_merge_complete_bodies(spark):
    pages = spark.createDataFrame(
        [("u1", "h", "Acme brand", "B", False), ("u2", "h", "acme BRAND", "B", False), ("u3", "h", "acme brand", "B", None), ("u4", "h", "none", "C", False)],
        "url STRING, hostname STRING, content STRING, content_sha256 STRING, body_truncated BOOLEAN",
    ).withColumn("title", F.lit("t"))
    ids = spark.createDataFrame([("u4", "handle", "neo")], "page_url STRING, ioc_type STRING, value STRING")
    creds = spark.createDataFrame([("u4", "a@acme.com")], "page_url STRING, email STRING")
    lists = spark.createDataFrame(
        [(1, "k", "keyword", "acme brand", None, True), (2, "i", "ioc", "neo", None, True), (3, "e", "email", "A@Acme.com", None, True), (4, "d", "domain", "h", None, True), (5, "x", "keyword", "acme", None, False)], WATCHLISTS)
    none = spark.createDataFrame([], NONE_PRIOR)
    matches = al.content_matches(lists, pages, ids, creds)
    got = al.content_alerts(lists, matches, pages, none)
    keys = sorted((r["watchlist_id"], r["page_url"]) for r in got.collect())
    assert keys == [(1, "u1"), (1, "u3"), (2, "u4"), (3, "u4"), (4, "u1"), (4, "u3"), (4, "u4")]
    assert al.content_alerts(lists, matches, pages, got).count() == 0
    seen = spark.createDataFrame([(1, "u2", "u2")], NONE_PRIOR)
    assert sorted(r["page_url"] for r in al.content_alerts(lists, matches, pages, seen).filter("watchlist_id = 1").collect()) == ["u3"]


def test_keywords_of_every_length(spark):
    pages = spark.createDataFrame([(f"u{i}", "h", t, "T") for i, t in enumerate(["Word text", None, "", "a", "é\U0001f600x wo", "sword"])], "url STRING, hostname STRING, content STRING, title STRING")
    lists = [(1, "WORD"), (2, "é\U0001f600X"), (3, "wo"), (4, "a"), (5, ""), (6, "absent"), (7, "word"), (8, None), (9, "t\x00x")]
    df = spark.createDataFrame([(i, "k", "keyword", v, None, True) for i, v in lists], WATCHLISTS)
    want = sorted((i, r["url"]) for r in pages.collect() for i, v in lists if v is not None and v.lower() in f"{(r['content'] or '').lower()}\x00t")
    assert sorted(map(tuple, al._keyword_matches(df, pages).collect())) == want


# --- runs, versions, audit ---

RUN = "run_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, heartbeat_at TIMESTAMP, pages_crawled BIGINT, queued_at_start BIGINT, due_at_start BIGINT, error STRING"


def passes(spark, *specs):
    rows = []
    for i, (status, minutes_ago, crawled, queued) in enumerate(specs):
        at = NOW - dt.timedelta(minutes=minutes_ago)
        rows.append((i, at, None if status == "running" else at, status, None, crawled, queued, 0, None))
    return spark.createDataFrame(rows, RUN)


@pytest.mark.parametrize(
    ("specs", "status", "stalled"),
    [
        ([], "unknown", 0),
        ([("running", 1, 0, 0)], "unknown", 0),
        ([("abandoned", 9, 0, 0)], "failing", 0),
        ([("abandoned", 9, 0, 0), ("running", 1, 0, 0)], "unknown", 0),
        ([("ok", 5, 0, 0)], "idle", 0),
        ([("ok", 5, 0, 7)], "ok", 1),
        ([("ok", 9, 0, 7), ("ok", 5, 0, 7)], "stalled", 2),
        ([("ok", 9, 0, 7), ("ok", 8, 3, 7), ("ok", 5, 0, 7)], "ok", 1),
        ([("ok", 90, 5, 0)], "stale", 0),
        ([("ok", 90, 5, 0), ("running", 5, 0, 0)], "ok", 0),
        ([("ok", 90, 5, 0), ("running", 80, 0, 0)], "stale", 0),
        ([("ok", 9, 5, 0), ("error", 5, 0, 0)], "failing", 0),
    ],
)
def test_collection_health(spark, specs, status, stalled):
    row = history.collection_health(passes(spark, *specs) if specs else spark.createDataFrame([], RUN), NOW).first()
    assert (row["status"], row["consecutive_stalled"]) == (status, stalled)


def test_audit_chain_across_chunks(spark):
    rows, prev = [], "0" * 64
    for i in range(1, 26):
        fields = [prev, "é user", "act", '{"k": %d}' % i, "2024-01-01T00:00:00"]
        digest = hashlib.sha256(json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        rows.append([i, *fields[1:], prev, digest])
        prev = digest
    schema = "id BIGINT, actor STRING, action STRING, detail STRING, at STRING, previous_hash STRING, entry_hash STRING"

    def verdict(data, width=10):
        return history.audit_verdict(history.check_audit_chain(spark.createDataFrame(data, schema), width)).first()

    good = verdict(rows)
    assert good["valid"] and good["entries"] == 25 and good["head_hash"] == prev
    assert verdict([r for r in rows if r[0] != 10])["failed_id"] == 11
    rows[16][2] = "edited"
    assert verdict(rows)["failed_id"] == 17


def test_version_changes_and_retention(spark):
    rows = [(i, "p", NOW, "t", c, b"x", "h", False, False) for i, c in enumerate(["a\nb", "a\nc\nd", "a\nc\nd"])] + [(9, "blocked", NOW, "t", "z", None, "h", False, False)]
    v = spark.createDataFrame(rows, VERSIONS)
    changes = history.version_changes(v, F.floor(F.col("version_id") / 2)).orderBy("after_id").collect()
    got = [(r["before_id"], r["after_id"], r["added"], r["removed"]) for r in changes]
    assert got == [(0, 1, ["c", "d"], ["b"]), (1, 2, [], [])]
    texts = ["x\nx\ny", "x\ny\nx\nz\nz", "z\nx\nz\nx\ny"]
    again = spark.createDataFrame([(i, "p", NOW, "t", c, b"x", "h", False, False) for i, c in enumerate(texts)], VERSIONS)
    assert [(r["added"], r["removed"], r["moved"]) for r in history.version_changes(again).orderBy("after_id").collect()] == [(["z", "z"], [], False), ([], [], True)]
    cited = spark.createDataFrame([(0,), (9,)], "version_id BIGINT")
    blocked = spark.createDataFrame([("blocked",)], "page_url STRING")
    assert sorted(r["version_id"] for r in history.retained_versions(v, cited, blocked, 1).collect()) == [0, 2]


# --- exports ---


def test_stix_objects(spark):
    ids = spark.createDataFrame([("p2", "handle", "o'neil\\x", NOW), ("p1", "handle", "o'neil\\x", NOW), ("p1", "cve", "cve-2024-1111", NOW), ("p3", "cve", "CVE-2024-1111", NOW), ("p1", "person", "Bob", NOW)],
                                "page_url STRING, ioc_type STRING, value STRING, created_at TIMESTAMP")
    actors = spark.createDataFrame([("a1", "handle:o'neil\\x", 1, 2, NOW)], "actor_id STRING, label STRING, identifiers BIGINT, page_count BIGINT, created_at TIMESTAMP")
    members = spark.createDataFrame([("a1", "handle", "o'neil\\x")], "actor_id STRING, ioc_type STRING, value STRING")
    rows = stix.bundle_objects(ids, actors, members).collect()
    objects = {r["type"]: json.loads(r["object"]) for r in rows}
    assert sorted(r["type"] for r in rows) == ["identity", "indicator", "relationship", "threat-actor", "vulnerability"]
    assert objects["indicator"]["pattern"] == "[user-account:account_login = 'o\\'neil\\\\x']" and objects["indicator"]["description"] == "Observed on p1"
    assert objects["relationship"]["source_ref"] == objects["indicator"]["id"] and objects["relationship"]["target_ref"] == objects["threat-actor"]["id"]
    assert objects["vulnerability"]["name"] == "CVE-2024-1111" and objects["indicator"]["created"] == "2024-05-01T12:00:00.000Z"
    assert stix.bundle_id(stix.bundle_objects(ids, actors, members)).first()["id"].startswith("bundle--")


def test_manifest_verifies_and_tampering_shows(spark):
    body = b"<p>x</p>"
    rows = [("http://h/1", "t", "x", "<p>x</p>", body, hashlib.sha256(body).hexdigest(), False, False, NOW, NOW), ("http://h/2", "t", "y", None, None, "00", None, False, None, NOW)]
    pages = spark.createDataFrame(rows, "url STRING, title STRING, content STRING, html STRING, raw_body BINARY, content_sha256 STRING, body_truncated BOOLEAN, blocked BOOLEAN, content_captured_at TIMESTAMP, fetched_at TIMESTAMP")
    m, members = evidence.manifest(pages), evidence.artefacts(pages)
    assert {r["url"]: r["complete_body_verifiable"] for r in m.collect()} == {"http://h/1": True, "http://h/2": False}
    assert evidence.verify_manifest(m, members, evidence.checksums(members)).count() == 0
    bad = members.withColumn("bytes", F.when(F.col("name").endswith(".body"), F.encode(F.lit("!"), "UTF-8")).otherwise(F.col("bytes")))
    problems = {r["problem"] for r in evidence.verify_manifest(m, bad, evidence.checksums(members)).collect()}
    assert problems == {"checksum mismatch", "body does not match the manifest", "inconsistent verification claim"}
    versions = pages.limit(1).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_id"), F.lit(False).alias("legacy"), F.lit('{"agent": "a1"}').alias("capture_metadata"))
    old = versions.withColumn("content", F.concat("content", F.col("version_id").cast("string")))
    m2, members2 = evidence.manifest(old, historical=True), evidence.artefacts(old, historical=True)
    assert evidence.verify_manifest(m2, members2, evidence.checksums(members2)).count() == 0
    assert {(r["version_id"], r["collector"]["agent"], r["hostname"]) for r in m2.collect()} == {(1, "a1", "h"), (2, "a1", "h")}
    assert evidence.same_members(members, evidence.checksums(members).filter(~F.col("name").endswith(".html"))).count() == 1


def test_metrics_and_reviews(spark):
    keys = "s STRING, k STRING"
    m = evaluate.set_metrics(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], keys), spark.createDataFrame([("a", "x"), ("b", "z")], keys), ["s", "k"]).first()
    assert (m["true_positive"], m["false_positive"], m["false_negative"], m["precision"], m["recall"]) == (1, 1, 1, 0.5, 0.5)
    none = spark.createDataFrame([], keys)
    assert evaluate.set_metrics(none, none, ["s", "k"]).first()["precision"] is None
    ex = spark.createDataFrame([(1, "Notebook", "confirmed"), (2, "news", "false_positive")], "review_id BIGINT, expected STRING, verdict STRING")
    out = evaluate.review_outcomes(ex, spark.createDataFrame([(1, "Notebook"), (2, "news")], "review_id BIGINT, value STRING"))
    assert {r["review_id"]: r["passed"] for r in out.collect()} == {1: True, 2: False}


# --- sources ---


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# c\n\nfraud: car(d|t): x\nbroken line\nspam:\\bbuy\\b\n")
    assert [(r["category"], r["pattern"]) for r in readers.read_rules(spark, str(tmp_path / "rules.txt")).orderBy("position").collect()] == [("fraud", "car(d|t): x"), ("spam", "\\bbuy\\b")]
    (tmp_path / "bad.txt").write_text("# c\nABC note\n\nabc\ndef\n")
    assert sorted(r["sha256"] for r in readers.read_known_bad(spark, str(tmp_path / "bad.txt")).collect()) == ["abc", "def"]
    for folder, packs in {"b": {"one": {"name": "one", "category": "z", "sources": [{"url": "u1"}, {"note": "no url"}]}, "two": {"sources": []}}, "o": {"mine": {"name": "one", "category": "a", "sources": [{"url": "u9"}]}}}.items():
        (tmp_path / folder).mkdir()
        for name, pack in packs.items():
            (tmp_path / folder / f"{name}.json").write_text(json.dumps(pack, indent=1))
    (tmp_path / "b" / "zz.json").write_text("{ not json")
    packs = readers.read_source_packs(spark, str(tmp_path / "b"), str(tmp_path / "o"))
    assert [(r["name"], r["origin"], r["category"], [s["url"] for s in r["sources"]]) for r in packs.collect()] == [("one", "operator", "a", ["u9"]), ("two", "bundled", "other", [])]
    examples = spark.createDataFrame([(1, "iocs", "x", "confirmed", "text", "h", "r")], "review_id BIGINT, extractor STRING, expected STRING, verdict STRING, text STRING, body_sha256 STRING, reason STRING")
    writers.write_regression_examples(examples, str(tmp_path / "ex"))
    assert readers.read_reviewed_examples(spark, str(tmp_path / "ex")).first()["expected"] == "x"
    (tmp_path / "v2.json").write_text(json.dumps({"schema_version": 2, "examples": [{"review_id": 1}]}))
    with pytest.raises(Exception, match="another schema version"):
        readers.read_reviewed_examples(spark, str(tmp_path / "v2.json")).collect()
    writers.write_indicator_csv(spark.createDataFrame([("p", "btc", 'a"b'), ("p", "email", "x@y")], "page_url STRING, ioc_type STRING, value STRING"), str(tmp_path / "csv"), "actor")
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()] == [("btc", 'a"b', "p")]


def test_host_packs_count_listings_of_every_price(spark, tmp_path):
    from tidelog.plans.exports import QUERIES

    # Host source2 has prices from 101.50 up only, source1 none, source3 two.
    docs = [(100 + i, "plain", "en", "source2", 5) for i in range(40)] + [(300 + i, "plain", "en", "source1", 5) for i in range(30)] + [(400, "plain", "en", "source3", 5), (401, "plain", "en", "source3", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.pack, r.hostname): r.evidence for r in QUERIES["host_packs"].plan(spark, str(tmp_path)).collect()}
    assert got[("commerce", "source2.onion")] == "40 listing(s) extracted" and {h for p, h in got if p == "commerce"} == {"source2.onion"}
    assert {h for p, h in got if p == "actor-infrastructure"} == {"source1.onion", "source3.onion"}
