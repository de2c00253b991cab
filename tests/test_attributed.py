"""Attribution exports: identifiers follow their page, and give the clusters and actors of the plain way."""

import pytest
from pyspark.sql import functions as F
from test_graph import IND, random_rows
from test_volume import shuffled

from tidelog.operators import clusters, stix


def sightings(spark, rows):
    return spark.createDataFrame(rows, IND).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Pages that link, pages with too many identifiers, an identifier that is only repeated on its own page.
ROWS = [
    *random_rows(7, pages=30, values=60),
    *[("many1", "eth", f"e{i}", "") for i in range(12)], ("many1", "handle", "v3", ""), ("many1", "btc", "v3", ""),
    *[("many2", "eth", f"f{i}", "") for i in range(12)], ("many2", "handle", "v3", ""), ("many2", "eth", "e1", ""),
    ("own", "btc", "twice", ""), ("own", "btc", "twice", ""), ("alone", "btc", "once", ""), ("alone", "email", "a@b.example", ""),
]


@pytest.mark.parametrize("slot_rows", [1_000_000, 0])
def test_attributed_equals_the_plain_way(spark, monkeypatch, slot_rows):
    """Without rows in a slot every page takes the way of overfull ones."""
    monkeypatch.setattr(clusters, "SLOT_ROWS", slot_rows)
    ids = sightings(spark, ROWS)
    plain = clusters.resolve_clusters(ids)
    people = clusters.actors(ids, plain)
    firsts, got, members = clusters.attributed(ids, {"name": F.col("label")})
    assert rows_of(got, "actor_id", "label", "identifiers", "page_count", "cluster") == rows_of(people, "actor_id", "label", "identifiers", "page_count", "cluster")
    wanted = clusters.actor_identifiers(people, plain).join(people.select("actor_id", F.col("label").alias("name")), "actor_id")
    assert rows_of(members, "actor_id", "ioc_type", "value", "name") == rows_of(wanted, "actor_id", "ioc_type", "value", "name")
    first = {}
    for url, kind, value, _ in ROWS:
        if kind != "email":
            first[kind, value] = min(first.get((kind, value), url), url)
    assert rows_of(firsts, "ioc_type", "value", "page_url") == sorted((*k, v) for k, v in first.items())


def test_attribution_objects_equal_those_of_the_bundle(spark):
    ids = sightings(spark, ROWS)
    created = F.lit("2024-02-01 00:00:00").cast("timestamp")
    plain = clusters.resolve_clusters(ids)
    people = clusters.actors(ids, plain).withColumn("created_at", created)
    wanted = stix.bundle_objects(ids, people, clusters.actor_identifiers(people, plain), attribution_only=True)
    firsts, got, members = clusters.attributed(ids, {"target_ref": stix.actor_reference(), "created_at": created})
    found = stix.attribution_objects(firsts, got.withColumn("created_at", created), members)
    assert rows_of(found, "id", "type", "object") == rows_of(wanted, "id", "type", "object")


def test_identifiers_of_one_page_are_shuffled_few_times(spark):
    rows = [(f"p{i}", "eth", f"e{i}-{j}", "") for i in range(800) for j in range(5)]
    ids = sightings(spark, rows)

    def run():
        firsts, people, members = clusters.attributed(ids, {"target_ref": stix.actor_reference(), "created_at": F.lit(None).cast("timestamp")})
        stix.object_counts(stix.attribution_objects(firsts, people.withColumn("created_at", F.lit(None).cast("timestamp")), members)).collect()

    # By identifier once, by page once, ids of indicators and relationships once; the rest is by page.
    assert shuffled(spark, run) < 6 * len(rows)


def test_ids_that_stand_twice_count_once(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", "w")]
    got = stix.object_counts(spark.createDataFrame(rows, "type STRING, id STRING"))
    assert rows_of(got, "type", "objects", "ids") == [("a", 3, 2), ("b", 2, 2)]
