"""HTML pages to text, meta fields, links and product blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hosts import hostname, is_onion
from ..functions.html_text import read_page, resolve_link
from ..schemas import PARSED_PAGE

# Pages that are Python objects at once.
SLICE = 128
_LINK = pa.struct([("url", pa.string()), ("anchor_text", pa.string())])
PARSED_ARROW = pa.struct([*[(name, pa.string()) for name in ("title", "description", "keywords", "text")], ("links", pa.list_(_LINK)), ("blocks", pa.list_(pa.string()))])


def _read_slice(urls: pa.Array, bodies: pa.Array) -> pa.StructArray:
    pages = [read_page(body, base or "") for base, body in zip(urls.to_pylist(), bodies.to_pylist(), strict=True)]
    return pa.array(pages, PARSED_ARROW)


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``title, description, keywords, text, links, blocks``.

    Only the two input columns travel to Python, in Arrow batches; the html itself is dropped from the output.  Python objects exist
    for ``SLICE`` pages at a time, whatever the size of a batch.
    """

    @F.arrow_udf(PARSED_PAGE)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, bodies in batches:
            parts = [_read_slice(urls.slice(at, SLICE), bodies.slice(at, SLICE)) for at in range(0, len(urls), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], PARSED_ARROW)

    # asNondeterministic keeps the optimizer from running the parser once per referenced field.
    parsed = pages.withColumn("_p", read.asNondeterministic()(url, html))
    return parsed.select(*[c for c in pages.columns if c != html], "_p.*")


def page_links(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Edges ``(url, position, target, anchor_text, target_host, onion)``, one row per link discovered at a url.

    A url stored several times has the links of all its rows, each once, by its first place and then by target.
    """
    found = parsed.select(F.col(url).alias("url"), F.posexplode("links").alias("_at", "l")).groupBy("url", F.col("l.url").alias("target"))
    first = found.agg(F.min(F.struct("_at", F.col("l.anchor_text").alias("anchor_text"))).alias("f"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("url").orderBy("f._at", "target")) - 1)
    return placed.select(
        "url",
        "position",
        "target",
        F.col("f.anchor_text").alias("anchor_text"),
        hostname(F.col("target")).alias("target_host"),
        is_onion(F.col("target")).alias("onion"),
    )


def normalize_links(links: DataFrame, base: str = "base", href: str = "href", into: str = "url") -> DataFrame:
    """Resolve ``href`` against ``base``; unusable references become null."""

    @F.pandas_udf("string")
    def resolve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, hrefs in batches:
            yield pd.Series([resolve_link(b or "", h) for b, h in zip(bases, hrefs)], dtype="object")

    return links.withColumn(into, resolve(base, href))
