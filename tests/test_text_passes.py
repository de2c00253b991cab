"""How often extraction reads a text, and that the shorter way finds the same."""

import re

from tidelog.operators import indicators, records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "page_url STRING, text STRING")


def test_credentials_read_the_text_once(spark):
    texts = ["x.a@b.co:secret1 c%d@e.org | pw:23 ..lead@f.io:abc", "a.-u@b.co.uk : " + "s" * 90 + " v@w.net:ab q@r.st:\nlong|er x@y.zz:|||", None, "no address"]
    found = records.extract_credentials(pages(spark, *texts))
    assert plan(found).count("regexp_extract_all(") == 1
    want = {(str(i), m.lower(), s) for i, t in enumerate(texts) if t for m, s in re.findall(records.CREDENTIAL.replace("(?U)", ""), t)}
    assert sorted((r["page_url"], r["email"]) for r in found.collect()) == sorted((u, m) for u, m, _ in want) and len(want) == 6


def test_surroundings_are_read_where_a_price_is(spark):
    found = records.extract_listings(pages(spark, "ref 1234 btc and USD or ethics 77", "old 0.5 BTC lamp 12 EUR £3 chair $4.50 desk €5"))
    assert sorted((r["page_url"], r["price"], r["currency"]) for r in found.collect()) == [("1", 0.5, "BTC"), ("1", 3.0, "GBP"), ("1", 4.5, "USD"), ("1", 5.0, "EUR"), ("1", 12.0, "EUR")]
    # Coins in other words are no reason to read the surroundings three times.
    assert "(?i)BTC|XMR|ETH)" not in plan(found)


def test_a_value_is_located_once(spark):
    texts = ["Vendor: Neo77 sells", "x" * 200 + " mail A.b@Corp.example " + "y" * 200, "cve-2024-1234", None]
    found = indicators.extract_indicators(pages(spark, *texts))
    assert plan(found).lower().count("locate(") == 1 and "locate(" not in plan(found.drop("context")).lower()
    assert sorted((r["value"], r["context"]) for r in found.collect()) == [("A.b@Corp.example", "x" * 74 + " mail A.b@Corp.example " + "y" * 79), ("Neo77", texts[0]), ("cve-2024-1234", texts[2])]
