"""Indicator extraction: one page row becomes many (type, value, context) rows.

Everything is one projection per page: each pattern yields an array, arrays are de-duplicated, filtered and capped in
place, and a single explode emits the rows.  No shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import base58check_valid
from ..functions.keyblock import ARMOUR, armour_fingerprint

MAX_VALUE_CHARS = 512
CONTEXT_CHARS = 80

# The patterns of the identifier types (Unicode word boundaries throughout).
BTC = r"(?U)\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
ETH = r"(?U)\b0x[a-fA-F0-9]{40}\b"
XMR = r"(?U)\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b"
ONION = r"(?iU)\b[a-z2-7]{56}\.onion\b"
CVE = r"(?iU)\bCVE-\d{4}-\d{4,7}\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
JABBER = r"(?iU)(?:jabber|xmpp)\b\s*(?:id|address)?\s*[:\-=]?\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
HANDLE_LABEL = r"(?iU)\b(?:vendor|seller)\s*(?:name)?\s*:\s*([A-Za-z0-9][A-Za-z0-9_.\-]{2,31})\b"
HANDLE_SOLD_BY = r"(?iU)\bsold\s+by\s*:?\s*([A-Za-z0-9][A-Za-z0-9_.\-]{2,31})\b"
SPACED_KEY = r"(?iU)\b(?:[A-F0-9]{4}[ \t]+){9}[A-F0-9]{4}\b"
KEY_WORDS = r"(?iU)(?:pgp|gpg|fingerprint|key\s*id|public\s+key)"
KEY_WINDOW = 120

# Mail hosts whose addresses identify an operator rather than a victim.
CONTACT_DOMAINS = (
    "protonmail.com", "protonmail.ch", "proton.me", "pm.me",
    "tutanota.com", "tutanota.de", "tutamail.com", "tuta.io",
    "riseup.net", "systemli.org", "autistici.org", "disroot.org",
    "cock.li", "airmail.cc", "firemail.cc", "waifu.club",
    "onionmail.org", "onionmail.info", "secmail.pro", "dnmx.org",
    "elude.in", "mail2tor.com", "danwin1210.de", "torbox3uiot6wchz.onion",
    "ctemplar.com", "mailfence.com", "safe-mail.net", "sonar.email",
    "thesecure.biz", "exploit.im", "jabber.ru", "xmpp.jp", "jabb.im",
    "creep.im", "chatme.im", "swissjabber.de", "404.city",
)

# Words that follow a vendor label without naming anyone.
HANDLE_STOPWORDS = (
    "products", "product", "login", "register", "registration", "name",
    "page", "home", "info", "the", "and", "profile", "feedback", "rating",
    "unknown", "anonymous", "none", "null", "search", "category",
)

# A supplementary character inside a look-behind makes the regex engine count code points there instead of UTF-16 units.
ANY_CHAR = "[\\s\\S\U0001f600]"


PAD = "\x00"


def before_window(chars: int) -> str:
    """Look-behind capturing the ``chars`` characters before a match in text made by ``padded``."""
    return f"(?<=({ANY_CHAR}{{{chars}}}))"


def padded(text: Column, chars: int) -> Column:
    """Text with ``chars`` filler characters in front, so a window of fixed width exists before every match."""
    return F.concat(F.lit(PAD * chars), text)


def unpadded(window: Column) -> Column:
    return F.ltrim(window, F.lit(PAD))


# The look-ahead runs first, so the window is only measured at real candidates.
_BARE_KEY = (
    r"(?iU)\b(?=(?:0x)?[A-F0-9]{40}\b)" + before_window(KEY_WINDOW) + r"(?:0x)?([A-F0-9]{40})\b"
)


def _none() -> Column:
    return F.array().cast("array<string>")


def _all(text: Column, pattern: str, group: int = 0, unless_missing: Column | None = None) -> Column:
    """Distinct matches in text order.  ``unless_missing`` is a cheap test that spares the regex on most pages."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return found if unless_missing is None else F.when(unless_missing, found).otherwise(_none())


def key_fingerprints(text: Column) -> Column:
    """Fingerprints in discovery order: armoured blocks, ten spaced quads, bare 40-hex near key words."""
    armoured = F.when(
        text.contains("-----BEGIN PGP PUBLIC KEY BLOCK-----"),
        F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(ARMOUR), F.lit(1)), armour_fingerprint)),
    ).otherwise(_none())
    spaced = F.transform(_all(text, SPACED_KEY), lambda v: F.upper(F.regexp_replace(v, "[ \t]", "")))
    # Pairs of (preceding window, hex); both arrays come from the same pattern, so they line up.
    near = F.filter(
        F.arrays_zip(
            F.regexp_extract_all(padded(text, KEY_WINDOW), F.lit(_BARE_KEY), F.lit(1)).alias("before"),
            F.regexp_extract_all(padded(text, KEY_WINDOW), F.lit(_BARE_KEY), F.lit(2)).alias("hex"),
        ),
        lambda m: m["before"].rlike(KEY_WORDS),
    )
    bare = F.when(text.rlike("[A-Fa-f0-9]{40}"), F.transform(near, lambda m: F.upper(m["hex"]))).otherwise(_none())
    return F.array_distinct(F.concat(armoured, spaced, bare))


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value")))


def _is_contact(address: Column) -> Column:
    domain = F.lower(F.substring_index(address, "@", -1))
    return domain.endswith(".onion") | domain.isin(*CONTACT_DOMAINS)


def extract_indicators(pages: DataFrame, url: str = "page_url", text: str = "text", max_per_type: int | None = None) -> DataFrame:
    """``(page_url, ioc_type, value, context)`` rows of every page, at most ``max_per_type`` per type and page."""
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = pages.select(F.col(url).alias("page_url"), t.alias("_text"), key_fingerprints(t).alias("_keys"))
    t = F.col("_text")
    wallets = F.filter(
        _all(t, BTC), lambda v: v.startswith("bc1") | base58check_valid(v)
    )
    ethers = F.filter(
        _all(t, ETH, unless_missing=t.contains("0x")),
        lambda v: ~F.array_contains(F.col("_keys"), F.upper(v.substr(3, 40))),
    )
    handles = F.array_distinct(
        F.filter(
            F.concat(
                _all(t, HANDLE_LABEL, 1, t.rlike("(?i)vendor|seller")), _all(t, HANDLE_SOLD_BY, 1, t.rlike("(?iU)sold\\s+by"))
            ),
            lambda v: ~F.lower(v).isin(*HANDLE_STOPWORDS),
        )
    )
    has_at = t.contains("@")
    jabbers = _all(t, JABBER, 1, has_at & t.rlike("(?i)jabber|xmpp"))
    staged = keyed.select(
        "page_url",
        "_text",
        "_keys",
        jabbers.alias("_jabbers"),
        _all(t, EMAIL, unless_missing=has_at).alias("_mails"),
        wallets.alias("_btc"),
        ethers.alias("_eth"),
        _all(t, XMR).alias("_xmr"),
        _all(t, ONION, unless_missing=t.rlike(r"(?i)\.onion")).alias("_onion"),
        _all(t, CVE, unless_missing=t.rlike("(?i)cve-")).alias("_cve"),
        handles.alias("_handles"),
    )
    mails = F.array_except("_mails", "_jabbers")
    per_type = {
        "pgp_fp": F.col("_keys"),
        "btc": F.col("_btc"),
        "eth": F.col("_eth"),
        "xmr": F.col("_xmr"),
        "onion": F.col("_onion"),
        "cve": F.col("_cve"),
        "pgp": F.when(
            t.contains("BEGIN PGP PUBLIC KEY BLOCK") & (F.size("_keys") == 0), F.array(F.lit("present"))
        ).otherwise(_none()),
        "jabber": F.col("_jabbers"),
        "contact_email": F.filter(mails, _is_contact),
        "email": F.filter(mails, lambda a: ~_is_contact(a)),
        "handle": F.col("_handles"),
    }
    packed = F.concat(*[_tagged(values if max_per_type is None else F.slice(values, 1, max_per_type), kind) for kind, values in per_type.items()])
    # The lower-cased text is computed once per page, below the explode.
    rows = staged.select("page_url", "_text", F.lower("_text").alias("_lower"), F.explode(packed).alias("i"))
    # A column of its own, so that a value is located once and not wherever the place is used.
    rows = rows.select("page_url", "_text", "i", F.expr("locate(lower(i.value), _lower)").alias("_at"))
    at = F.col("_at")
    start = F.greatest(at - CONTEXT_CHARS, F.lit(1))
    context = F.when(at > 0, F.col("_text").substr(start, at + F.length("i.value") + CONTEXT_CHARS - start))
    return rows.select(
        "page_url", "i.ioc_type", F.col("i.value").substr(1, MAX_VALUE_CHARS).alias("value"), context.alias("context")
    )
