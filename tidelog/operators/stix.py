"""STIX 2.1 objects as rows of ``(id, type, object)`` with ``object`` a JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import uuid5
from ..functions.predicates import indicator_types
from ..functions.text import iso_millis
from ..session import Scratch

# Fixed value: the namespace the STIX 2.1 specification defines for deterministic ids.
STIX_NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
IDENTITY_STAMP = "2026-01-01T00:00:00.000Z"
# Identifier type -> observable path and indicator label.
PATTERNS = (
    ("onion", "domain-name:value", "anonymous-service"),
    ("email", "email-addr:value", "compromised"),
    ("contact_email", "email-addr:value", "attribution"),
    ("jabber", "email-addr:value", "attribution"),
    ("handle", "user-account:account_login", "attribution"),
    ("btc", "cryptocurrency-wallet:value", "attribution"),
    ("eth", "cryptocurrency-wallet:value", "attribution"),
    ("xmr", "cryptocurrency-wallet:value", "attribution"),
    ("pgp_fp", "x-pgp-key:fingerprint", "attribution"),
)
MAX_BUNDLE_OBJECTS = 1_000_000


def stix_id(kind: str, seed: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(STIX_NAMESPACE, seed))


def escape(value: Column) -> Column:
    """Backslashes and quotes inside a single-quoted pattern literal."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def identity(spark, producer: str) -> DataFrame:
    seed = F.lit(f"producer:{producer}")
    body = F.struct(
        F.lit("identity").alias("type"),
        F.lit("2.1").alias("spec_version"),
        stix_id("identity", seed).alias("id"),
        F.lit(IDENTITY_STAMP).alias("created"),
        F.lit(IDENTITY_STAMP).alias("modified"),
        F.lit(producer).alias("name"),
        F.lit("system").alias("identity_class"),
    )
    return spark.range(1).select(stix_id("identity", seed).alias("id"), F.lit("identity").alias("type"), F.to_json(body).alias("object"))


def exported(indicators: DataFrame, types: str | None = None, attribution_only: bool = False, limit: int | None = None) -> DataFrame:
    """Indicator rows of an export, in (type, value, page) order when limited."""
    rows = indicators.filter(indicator_types(types or ("actor" if attribution_only else None)))
    return rows.orderBy("ioc_type", "value", "page_url").limit(limit) if limit else rows


def _first_sighting(rows: DataFrame, *keys: Column) -> DataFrame:
    """One row per identifier, its first page by url; reduced inside each task before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct("page_url", "created_at")).alias("s"))


def _common(kind: str, seed: Column, producer: str, created: Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"),
        F.lit("2.1").alias("spec_version"),
        stix_id(kind, seed).alias("id"),
        stix_id("identity", F.lit(f"producer:{producer}")).alias("created_by_ref"),
        created.alias("created"),
        created.alias("modified"),
    ]


def indicator_objects(rows: DataFrame, producer: str) -> DataFrame:
    """One ``indicator`` per mapped identifier; unmapped types are omitted rather than mis-typed.

    ``rows``: ``ioc_type, value, page_url, created_at``.
    """
    mapped = rows.filter(F.col("ioc_type").isin(*[k for k, _, _ in PATTERNS]))
    return _indicators_of(_first_sighting(mapped, F.col("ioc_type"), F.col("value")), producer)


def _indicators_of(one: DataFrame, producer: str) -> DataFrame:
    paths = F.create_map(*[F.lit(p) for kind, path, _ in PATTERNS for p in (kind, path)])
    labels = F.create_map(*[F.lit(p) for kind, _, label in PATTERNS for p in (kind, label)])
    kind, value, created = F.col("ioc_type"), F.col("value"), iso_millis(F.col("s.created_at"))
    seed = F.concat(kind, F.lit(":"), value)
    body = F.struct(
        *_common("indicator", seed, producer, created),
        F.concat(kind, F.lit(": "), value.substr(1, 80)).alias("name"),
        F.concat(F.lit("Observed on "), F.col("s.page_url")).alias("description"),
        F.array(labels[kind]).alias("indicator_types"),
        F.concat(F.lit("["), paths[kind], F.lit(" = '"), escape(value), F.lit("']")).alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        created.alias("valid_from"),
        F.array(F.concat(F.lit(f"{producer}:"), kind)).alias("labels"),
    )
    return one.select(stix_id("indicator", seed).alias("id"), F.lit("indicator").alias("type"), F.to_json(body).alias("object"), "ioc_type", "value")


def vulnerability_objects(rows: DataFrame, producer: str) -> DataFrame:
    """One ``vulnerability`` per CVE, whatever its spelling on the page."""
    one = _first_sighting(rows.filter(F.col("ioc_type") == "cve"), F.upper("value").alias("name"))
    created, name = iso_millis(F.col("s.created_at")), F.col("name")
    seed = F.concat(F.lit("cve:"), name)
    body = F.struct(
        *_common("vulnerability", seed, producer, created),
        name.alias("name"),
        F.array(F.struct(F.lit("cve").alias("source_name"), name.alias("external_id"))).alias("external_references"),
    )
    return one.select(stix_id("vulnerability", seed).alias("id"), F.lit("vulnerability").alias("type"), F.to_json(body).alias("object"))


def actor_objects(actors: DataFrame, producer: str) -> DataFrame:
    """One ``threat-actor`` per cluster.  ``actors``: ``actor_id, label, identifiers, page_count, created_at``."""
    created = iso_millis(F.col("created_at"))
    seed = F.concat(F.lit("actor:"), F.col("label"))
    body = F.struct(
        *_common("threat-actor", seed, producer, created),
        F.col("label").alias("name"),
        F.concat(
            # Description text of the exported objects.
            F.lit("Cluster of "),
            F.col("identifiers").cast("string"),
            F.lit(" reused identifier(s) observed across "),
            F.coalesce("page_count", F.lit(0)).cast("string"),
            F.lit(" page(s). Inferred co-occurrence cluster, not verified identity."),
        ).alias("description"),
        F.array(F.lit("unknown")).alias("threat_actor_types"),
        F.array(F.lit(f"{producer}:resolved-cluster")).alias("labels"),
    )
    return actors.select(stix_id("threat-actor", seed).alias("id"), F.lit("threat-actor").alias("type"), F.to_json(body).alias("object"), "actor_id", created.alias("_created"))


def relationship_objects(indicator_rows: DataFrame, actor_rows: DataFrame, members: DataFrame, producer: str) -> DataFrame:
    """``indicates`` edges from exported indicators to the actors that own them."""
    owned = (
        members.join(indicator_rows.select("ioc_type", "value", F.col("id").alias("source_ref")), ["ioc_type", "value"])
        .join(actor_rows.select("actor_id", F.col("id").alias("target_ref"), "_created"), "actor_id")
    )
    return _relationships_of(owned, producer)


def _relationships_of(owned: DataFrame, producer: str) -> DataFrame:
    seed = F.concat(F.lit("indicates:"), F.col("source_ref"), F.lit(":"), F.col("target_ref"))
    body = F.struct(
        *_common("relationship", seed, producer, F.col("_created")),
        F.lit("indicates").alias("relationship_type"),
        "source_ref",
        "target_ref",
    )
    return owned.select(stix_id("relationship", seed).alias("id"), F.lit("relationship").alias("type"), F.to_json(body).alias("object"), "source_ref", "target_ref")


def bundle_objects(
    indicators: DataFrame,
    actors: DataFrame,
    members: DataFrame,
    producer: str = "tidelog",
    types: str | None = None,
    attribution_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Every object of an export."""
    rows = exported(indicators, types, attribution_only, limit)
    found, people = indicator_objects(rows, producer), actor_objects(actors, producer)
    parts = [identity(indicators.sparkSession, producer), found, vulnerability_objects(rows, producer), people, relationship_objects(found, people, members, producer)]
    out = parts[0].select("id", "type", "object")
    for part in parts[1:]:
        out = out.unionByName(part.select("id", "type", "object"))
    return out


def actor_reference() -> Column:
    """Id of the ``threat-actor`` of a row of actors."""
    return stix_id("threat-actor", F.concat(F.lit("actor:"), F.col("label")))


def attribution_objects(firsts: DataFrame, actors: DataFrame, members: DataFrame, producer: str = "tidelog") -> DataFrame:
    """Every object of an export of all attribution identifiers, from the tables of ``clusters.attributed``.

    ``firsts`` has one row for each identifier, ``members`` also ``target_ref`` and ``created_at`` of the actor.  Ids follow from types and values,
    so indicators and their relationships are built where the identifiers are, without a join.
    """
    mapped = F.col("ioc_type").isin(*[k for k, _, _ in PATTERNS])
    found = _indicators_of(firsts.filter(mapped).select("ioc_type", "value", F.struct("page_url", "created_at").alias("s")), producer)
    parts = [identity(firsts.sparkSession, producer), found, actor_objects(actors, producer), attribution_relationships(members, producer)]
    out = parts[0].select("id", "type", "object")
    for part in parts[1:]:
        out = out.unionByName(part.select("id", "type", "object"))
    return out


def attribution_relationships(members: DataFrame, producer: str) -> DataFrame:
    """``indicates`` edges from the ``members`` of actors, as ``attribution_objects`` has them."""
    mapped = members.filter(F.col("ioc_type").isin(*[k for k, _, _ in PATTERNS]))
    source = stix_id("indicator", F.concat("ioc_type", F.lit(":"), "value")).alias("source_ref")
    return _relationships_of(mapped.select(source, "target_ref", iso_millis(F.col("created_at")).alias("_created")), producer)


def object_counts(objects: DataFrame) -> DataFrame:
    """``(type, objects, ids)``: objects and different ids of every type.

    Ids meet by their hash; only those whose hash stands several times are compared themselves.
    """
    hashed = objects.select("type", "id", F.xxhash64("id").alias("h"))
    seen = hashed.select("type", "h").repartition("h").groupBy("type", "h").agg(F.count(F.lit(1)).alias("n"))
    totals = seen.groupBy("type").agg(F.sum("n").alias("objects"), F.count_if(F.col("n") == 1).alias("ids"))
    totals = Scratch(objects.sparkSession).cut(totals, "totals")
    if totals.filter(F.col("objects") > F.col("ids")).isEmpty():
        return totals
    several = seen.filter("n > 1").select(F.col("type").alias("_type"), F.col("h").alias("_h"))
    again = hashed.join(several, (F.col("type") == F.col("_type")) & (F.col("h") == F.col("_h")), "left_semi")
    again = again.groupBy("type").agg(F.countDistinct("id").alias("_more"))
    return totals.join(again, "type", "left").select("type", "objects", (F.col("ids") + F.coalesce("_more", F.lit(0))).alias("ids"))


def bundle_id(objects: DataFrame) -> DataFrame:
    """Content-derived id of one bundle document.

    A bundle is one document, so its id needs all object ids in order.  More than ``MAX_BUNDLE_OBJECTS`` objects are refused
    with an error: pass a limited export, or write the objects as JSON lines, which need no bundle.
    """
    numbered = objects.select("id").distinct().orderBy("id").limit(MAX_BUNDLE_OBJECTS + 1)
    joined = numbered.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ";").alias("ids"))
    return joined.select("n", F.when(F.col("n") <= MAX_BUNDLE_OBJECTS, stix_id("bundle", F.col("ids"))).otherwise(F.raise_error(F.lit(f"a bundle holds at most {MAX_BUNDLE_OBJECTS} objects"))).alias("id"))
