"""Structured records: hashed credentials, priced listings, and labels supplied by an outside annotator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, squash
from .indicators import ANY_CHAR, PAD, before_window, padded, unpadded

PRODUCT_CHARS = 70
RANGE_CHARS = 24

# Fixed value: an address, a separator and a secret of 3 to 80 characters.
_CREDENTIAL_PARTS = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\s*[:|]\s*(\S{3,80})"
CREDENTIAL = rf"(?U)\b{_CREDENTIAL_PARTS}"

# Price patterns in search order, with the currency they imply and the signs of which a text with a price has one.
PRICE_PATTERNS = (
    (r"\$\s?\d{1,7}(?:\.\d{1,2})?", "USD", ("$",)),
    (r"€\s?\d{1,7}(?:\.\d{1,2})?", "EUR", ("€",)),
    (r"£\s?\d{1,7}(?:\.\d{1,2})?", "GBP", ("£",)),
    (r"\b\d{1,7}(?:\.\d{1,2})?\s?(?:USD|EUR|GBP)\b", None, ("USD", "EUR", "GBP")),
    (r"(?i:\b\d(?:\.\d{1,8})?\s?(?:BTC|XMR|ETH)\b)", None, ()),
)
# Fixed value: words or dashes that make the following number a range bound.
RANGE_BEFORE = r"(?iU)(?:\b(?:from|to|between|upto|up\s+to)\s*|[-–—~]\s*)\z"


def extract_credentials(pages: DataFrame, url: str = "page_url", text: str = "text", max_per_page: int | None = None) -> DataFrame:
    """Breach-lookup rows.  The secret is hashed in the projection that finds it and never leaves it."""
    t = F.coalesce(F.col(text), F.lit(""))
    # The text is read once; a match alone splits as it did in its text.
    part = rf"(?U)\A{_CREDENTIAL_PARTS}\z"
    pairs = F.transform(
        F.regexp_extract_all(t, F.lit(CREDENTIAL), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, part, 1).alias("mail"), F.regexp_extract(m, part, 2).alias("secret")),
    )
    distinct = F.array_distinct(F.transform(pairs, lambda p: F.struct(F.lower(p["mail"]).alias("mail"), p["secret"].alias("secret"))))
    safe = F.transform(
        distinct if max_per_page is None else F.slice(distinct, 1, max_per_page),
        lambda p: F.struct(
            p["mail"].substr(1, 320).alias("email"),
            F.substring_index(p["mail"], "@", -1).substr(1, 255).alias("domain"),
            F.sha2(p["secret"], 256).alias("password_sha256"),
        ),
    )
    return pages.filter(t.contains("@")).select(F.col(url).alias("page_url"), F.explode(safe).alias("c")).select("page_url", "c.*")


def _record(currency: str | None):
    """Turn one (before, price, after) match into a listing struct; ``currency`` is None when the match names it."""

    def build(m: Column) -> Column:
        return bind(unpadded(m["pre"].substr(2, PRODUCT_CHARS)), lambda window: fields(m, window))

    def fields(m: Column, window: Column) -> Column:
        edge = m["pre"].substr(1, 1)
        mid_word = (edge != PAD) & ~edge.rlike(r"(?U)^\s") & window.contains(" ")
        trimmed = F.when(mid_word, F.substring(window, F.instr(window, " ") + 1, F.length(window))).otherwise(window)
        named = F.upper(F.regexp_extract(m["hit"], r"([A-Za-z]+)\z", 1))
        return F.struct(
            F.regexp_extract(m["hit"], r"(?U)(\d+(?:\.\d+)?)", 1).cast("double").alias("price"),
            (F.lit(currency) if currency else named).alias("currency"),
            squash(trimmed).alias("product"),
            F.concat(window, m["hit"], m["post"]).alias("context"),
        )

    return build


def _priced(text: Column) -> Column:
    """Array of ``(price, currency, product, context)`` in discovery order."""
    after = f"(?=({ANY_CHAR}{{0,{PRODUCT_CHARS}}}))"
    parts = []
    for price, currency, signs in PRICE_PATTERNS:
        # Without a sign, or where signs are common words, the price itself is looked for before its surroundings are.
        hint = reduce(Column.__or__, [text.contains(sign) for sign in signs]) if signs else F.lit(True)
        if currency is None:
            hint = hint & text.rlike(f"(?U){price}")
        # One character more than the product window, to see whether the window starts inside a word.
        # The look-ahead runs first, so the window is only measured where a price starts.
        pattern = f"(?U)(?={price}){before_window(PRODUCT_CHARS + 1)}({price}){after}"
        hits = F.arrays_zip(
            *[F.regexp_extract_all(padded(text, PRODUCT_CHARS + 1), F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "pre"), (2, "hit"), (3, "post"))]
        )
        kept = F.filter(hits, lambda m: ~F.right(m["pre"], F.lit(RANGE_CHARS)).rlike(RANGE_BEFORE))
        parts.append(F.when(hint, F.transform(kept, _record(currency))).otherwise(F.expr(
            "cast(array() as array<struct<price: double, currency: string, product: string, context: string>>)"
        )))
    return F.concat(*parts)


def _record_key(r: Column) -> Column:
    return F.concat_ws("\x00", F.round(r["price"], 8).cast("string"), r["currency"], r["product"])


def _first_of_each(records: Column, cap: int | None) -> Column:
    """Keep the first record of every (price, currency, product), in order, at most ``cap`` of them if given."""

    def firsts(rs: Column) -> Column:
        def pick(keys: Column) -> Column:
            return F.filter(rs, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1)

        return bind(F.transform(rs, _record_key), pick)

    kept = bind(records, firsts)
    return kept if cap is None else F.slice(kept, 1, cap)


def extract_listings(
    pages: DataFrame, url: str = "page_url", text: str = "text", blocks: str | None = None, max_per_page: int | None = None
) -> DataFrame:
    """Priced listings of every page.

    With a ``blocks`` column, pages that have product blocks are read block by block and their running text is ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    from_text = F.col("_text_records")
    if blocks is None:
        staged = pages.select(F.col(url).alias("page_url"), _priced(t).alias("_text_records"))
        capped = _first_of_each(from_text, max_per_page)
    else:
        has_blocks = F.coalesce(F.size(blocks) > 0, F.lit(False))
        per_block = F.flatten(
            F.transform(F.coalesce(F.col(blocks), F.array().cast("array<string>")), lambda b: _first_of_each(_priced(b), max_per_page))
        )
        staged = pages.select(
            F.col(url).alias("page_url"),
            F.when(has_blocks, per_block).otherwise(_priced(t)).alias("_text_records"),
        )
        capped = _first_of_each(from_text, max_per_page)
    return staged.select("page_url", F.explode(capped).alias("r")).select(
        "page_url",
        F.when(F.col("r.product") != "", F.col("r.product").substr(1, 512)).alias("product"),
        F.lit(None).cast("string").alias("vendor"),
        "r.price",
        "r.currency",
        "r.context",
    )


# What an outside annotator may call an entity, and the non-linking type it is stored as.
ANNOTATION_TYPES = (
    ("person", "person"),
    ("org", "org"),
    ("product", "product"),
    ("location", "location"),
    ("handle", "handle_llm"),
)


def annotation_entities(pages: DataFrame, annotations: DataFrame, min_chars: int = 200) -> DataFrame:
    """Entities of an annotation table ``(page_url, entities ARRAY<STRUCT<type, value>>)`` as indicator rows.

    Types outside the map are dropped, so an annotation can never create a linking identifier.
    """
    mapping = F.create_map(*[F.lit(part) for pair in ANNOTATION_TYPES for part in pair])
    long_enough = pages.filter(F.length("text") >= min_chars).select("page_url")
    return (
        annotations.join(long_enough, "page_url", "left_semi")
        .select("page_url", F.explode("entities").alias("e"))
        .select(
            "page_url",
            F.try_element_at(mapping, F.lower("e.type")).alias("ioc_type"),
            F.regexp_replace("e.value", r"(?U)^\s+|\s+$", "").alias("value"),
        )
        .filter(F.col("ioc_type").isNotNull() & (F.col("value") != ""))
        .withColumn("value", F.col("value").substr(1, 512))
        .withColumn("context", F.lit(None).cast("string"))
    )


def annotate_pages(pages: DataFrame, annotations: DataFrame, min_chars: int = 200) -> DataFrame:
    """Page labels (type, threat, summary, language) from the annotation table for pages long enough to be labelled."""
    labels = annotations.select(
        "page_url",
        F.col("page_type").alias("_page_type"),
        F.col("threat_category").alias("_threat"),
        F.col("summary").alias("_summary"),
        F.col("language").alias("_language"),
    )
    eligible = F.length("text") >= min_chars
    joined = pages.join(labels, "page_url", "left")
    old_language = F.col("language") if "language" in pages.columns else F.lit(None).cast("string")
    return joined.select(
        *[c for c in pages.columns if c not in ("page_type", "threat_category", "summary", "language")],
        F.when(eligible, F.col("_page_type")).alias("page_type"),
        F.when(eligible, F.col("_threat")).alias("threat_category"),
        F.when(eligible, F.col("_summary")).alias("summary"),
        F.coalesce(F.when(eligible & (F.col("_language") != ""), F.col("_language")), old_language).alias("language"),
    )


def replace_derived(stored: DataFrame, fresh: DataFrame, processed: DataFrame, extractor: str) -> DataFrame:
    """Derived rows after a reprocessing pass.

    ``processed`` has ``page_url`` and ``errors ARRAY<STRUCT<extractor, error_type>>``.  Rows of pages this extractor
    finished are replaced by ``fresh``; pages it failed on, or that were not processed, keep what they had.
    """
    failed = F.exists(F.coalesce("errors", F.expr("cast(array() as array<struct<extractor: string, error_type: string>>)")), lambda e: e["extractor"] == extractor)
    done = processed.filter(~failed).select("page_url")
    return stored.join(done, "page_url", "left_anti").unionByName(fresh.join(done, "page_url", "left_semi"))


def current_version_rows(derived: DataFrame, state: DataFrame) -> DataFrame:
    """Derived rows keyed by ``(page_url, content_sha256)`` that belong to the current, unblocked version."""
    current = state.filter(~F.coalesce("blocked", F.lit(False))).select(F.col("url").alias("page_url"), "content_sha256")
    return derived.join(current, ["page_url", "content_sha256"], "left_semi")
