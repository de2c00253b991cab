"""URL and host columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def hostname(url: Column) -> Column:
    """Lower-cased host without user info or port; empty string when there is none."""
    # One pattern: scheme, optional user info, then either a bracketed literal or everything up to port or path.
    return F.lower(
        F.regexp_replace(
            F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1), r"^\[|\]$", ""
        )
    )


def is_onion(url: Column) -> Column:
    return hostname(url).endswith(".onion")


def scope_host(url: Column) -> Column:
    """Canonical host of an acceptable crawl URL, null otherwise.

    Acceptable: at most 2048 characters, no whitespace or control characters, http or https, a host, no user info and
    a valid port.  Hosts outside ASCII need IDNA and yield null here; see ``operators.frontier.with_scope_host``.
    """
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":([^:\]@]*)$", 1)
    good_port = (port == "") | (port.rlike(r"^[0-9]{1,5}$") & (F.try_to_number(port, F.lit("99999")) <= 65535))
    host = F.regexp_replace(hostname(url), r"\.+$", "")
    ok = (
        (F.length(url) <= 2048)
        & ~url.rlike(r"(?U)[\s\x00-\x1f]")
        & (authority != "")
        & ~authority.contains("@")
        & good_port
        & (host != "")
        & host.rlike(r"^[\x00-\x7f]+$")
        & ~host.rlike(r"(^|\.)(\.|$)")
        & ~host.rlike(r"[^.]{64,}")
    )
    return F.when(ok, host)


def in_scope(url: Column, allowed: list[str] | None = None) -> Column:
    """Valid URL whose host is allowed; an empty allow-list admits every valid host."""
    host = scope_host(url)
    return host.isNotNull() if not allowed else F.coalesce(host.isin(*allowed), F.lit(False))


# IPv4 blocks that never leave a private or special-purpose network.
PRIVATE_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
# Names and suffixes that only resolve locally.
LOCAL_NAMES = ("localhost", "localhost.localdomain")
LOCAL_SUFFIXES = (".local", ".localhost", ".internal", ".test")


def bare_host(host: Column) -> Column:
    """Host without port or brackets; a bare IPv6 literal keeps its colons."""
    name = F.lower(F.trim(host))
    colons = F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit("")))
    return (
        F.when(name.startswith("["), F.regexp_extract(name, r"^\[([^\]]*)", 1))
        .when(colons == 1, F.split_part(name, F.lit(":"), F.lit(1)))
        .otherwise(name)
    )


def _v4_number(name: Column) -> Column:
    parts = F.split(name, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).cast("bigint")
    return total


def _v4_special(number: Column) -> Column:
    inside = F.lit(False)
    for block in PRIVATE_V4:
        network, bits = block.split("/")
        low = 0
        for part in network.split("."):
            low = low * 256 + int(part)
        inside = inside | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return inside


def _is_v4(name: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return name.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def _v6_special(name: Column) -> Column:
    """Loopback, unspecified, private, link-local, reserved and multicast IPv6 literals.

    Global unicast starts with a first group of 2000-3fff; within it only documentation and protocol blocks are special.
    """

    def group(pattern: str) -> Column:
        return F.coalesce(F.conv(F.concat(F.lit("0"), F.regexp_extract(name, pattern, 1)), 16, 10).cast("bigint"), F.lit(0))

    def special(g: Column) -> Column:
        first, second = g["first"], g["second"]
        return (
            ~first.between(0x2000, 0x3FFF)
            | ((first == 0x2001) & ((second < 0x200) | (second == 0xDB8)))
            | ((first == 0x3FFF) & (second < 0x1000))
            | (first == 0x2002)
        )

    groups = F.struct(group(r"^([0-9a-f]{0,4})").alias("first"), group(r"^[0-9a-f]{0,4}:([0-9a-f]{0,4})").alias("second"))
    return bind(groups, special)


def is_publishable(host: Column) -> Column:
    """Whether a host may appear in a pack sent to someone else."""
    return F.coalesce(bind(bare_host(host), _name_publishable), F.lit(False))


def _name_publishable(name: Column) -> Column:
    local = name.isin(*LOCAL_NAMES)
    for suffix in LOCAL_SUFFIXES:
        local = local | name.endswith(suffix)
    v6 = name.contains(":") & name.rlike(r"^[0-9a-f:.]+$")
    return (
        F.when((name == "") | local, F.lit(False))
        .when(_is_v4(name), ~bind(_v4_number(name), _v4_special))
        .when(v6, ~_v6_special(name))
        .otherwise(F.lit(True))
    )
