"""OpenPGP version 4 fingerprints from armoured text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

ARMOUR = r"-----BEGIN PGP PUBLIC KEY BLOCK-----([\s\S]*?)-----END PGP PUBLIC KEY BLOCK-----"


def _payload(block: Column) -> Column:
    """Base64 body of an armour block: header lines, blanks and the checksum line removed."""
    lines = F.transform(F.split(block, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda s: F.trim(
        F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    ))
    # Headers are the leading run of blank lines and lines with a colon; checksum lines start with "=".
    def body_of(all_lines: Column) -> Column:
        data = F.transform(all_lines, lambda line: (line != "") & ~line.contains(":"))
        start = F.array_position(data, True)
        rest = F.when(start > 0, F.slice(all_lines, start, F.size(all_lines))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.filter(rest, lambda line: ~line.startswith("=")), "")

    body = bind(lines, body_of)
    return F.regexp_replace(body, "[^A-Za-z0-9+/=]", "")


def _number(hex_text: Column, at: Column, n_bytes: int) -> Column:
    return F.conv(hex_text.substr(at * 2 - 1, F.lit(n_bytes * 2)), 16, 10).cast("bigint")


def armour_fingerprint(block: Column) -> Column:
    """Upper-case fingerprint of the first public-key packet, or null when the block is not a v4 key."""
    return bind(F.hex(F.try_to_binary(_payload(block), F.lit("base64"))), _packet_fingerprint)


def _packet_fingerprint(data: Column) -> Column:
    at = F.lit
    first = _number(data, at(1), 1)
    new_format = first.bitwiseAND(F.lit(0x40)) > 0
    octet = _number(data, at(2), 1)
    length_type = first.bitwiseAND(F.lit(3))
    tag = F.when(new_format, first.bitwiseAND(F.lit(0x3F))).otherwise(F.shiftright(first, 2).bitwiseAND(F.lit(0x0F)))

    def layout(header: int, size: Column) -> Column:
        return F.struct(F.lit(header).alias("header"), size.cast("bigint").alias("size"))

    shape = (
        F.when(new_format & (octet < 192), layout(2, octet))
        .when(new_format & (octet < 224), layout(3, (octet - 192) * 256 + _number(data, at(3), 1) + 192))
        .when(new_format & (octet == 255), layout(6, _number(data, at(3), 4)))
        .when(~new_format & (length_type == 0), layout(2, octet))
        .when(~new_format & (length_type == 1), layout(3, _number(data, at(2), 2)))
        .when(~new_format & (length_type == 2), layout(5, _number(data, at(2), 4)))
    )

    def digest(s: Column) -> Column:
        body = data.substr((s["header"] * 2 + 1).cast("int"), (s["size"] * 2).cast("int"))
        fits = (s["size"] > 0) & (s["size"] <= 0xFFFF) & (F.length(body) == s["size"] * 2) & (body.substr(1, 2) == "04")
        return F.when(fits, F.upper(F.sha1(F.unhex(F.concat(F.lit("99"), F.lpad(F.hex(s["size"]), 4, "0"), body)))))

    is_key = (F.length(data) >= 6) & (first >= 0x80) & (tag == 6)
    return F.when(is_key, bind(shape, digest))
