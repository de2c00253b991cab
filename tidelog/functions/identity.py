"""Deterministic identifiers and digests, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a string column under ``namespace``."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant_nibble = F.conv(digest.substr(17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(variant_nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        digest.substr(1, 8),
        F.lit("-"),
        digest.substr(9, 4),
        F.lit("-5"),
        digest.substr(14, 3),
        F.lit("-"),
        variant,
        digest.substr(18, 3),
        F.lit("-"),
        digest.substr(21, 12),
    )


def pair_key(left_type: Column, left_value: Column, right_type: Column, right_value: Column) -> Column:
    """SHA-256 of the compact JSON of the sorted identifier pair."""
    left = F.array(left_type, left_value)
    right = F.array(right_type, right_value)
    first = F.when(F.struct(left_type, left_value) <= F.struct(right_type, right_value), left).otherwise(right)
    second = F.when(F.struct(left_type, left_value) <= F.struct(right_type, right_value), right).otherwise(left)
    return F.sha2(F.to_json(F.array(first, second)), 256)


def audit_digest(previous: Column, actor: Column, action: Column, detail: Column, at: Column) -> Column:
    """SHA-256 of the compact JSON array of the five fields."""
    return F.sha2(F.to_json(F.array(previous, actor, action, detail, at)), 256)


def token_bucket(token: Column, dim: int) -> Column:
    """Stable bucket of a token."""
    return (F.crc32(token) % F.lit(dim)).cast("int")


_LIMBS = 7  # 7 x 32 bits hold any 35-character base58 number
_GROUP = 5  # digits folded at once: 58^5 x 2^32 stays below 2^63
_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _shift_plus(limbs: Column, group: Column) -> Column:
    """``limbs * 58^5 + group`` over little-endian 32-bit limbs."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), group.alias("carry"))

    def step(state: Column, limb: Column) -> Column:
        wide = limb * F.lit(58**_GROUP) + state["carry"]
        return F.struct(
            F.concat(state["out"], F.array(wide.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("out"),
            F.shiftright(wide, 32).alias("carry"),
        )

    return F.aggregate(limbs, start, step)["out"]


def base58check_valid(address: Column) -> Column:
    """Version 0 or 5 Base58Check address with a correct double SHA-256 checksum.

    The number is folded five digits at a time into 32-bit limbs, so the whole test stays in the JVM.
    """
    digits = F.transform(
        F.filter(F.split(F.lpad(address, _LIMBS * _GROUP, "1"), ""), lambda ch: ch != ""),
        lambda ch: F.instr(F.lit(_ALPHABET), ch).cast("bigint") - 1,
    )
    zero = F.array(*[F.lit(0).cast("bigint") for _ in range(_LIMBS)])
    leading_ones = F.length(address) - F.length(F.regexp_replace(address, "^1+", ""))

    def check(number: Column) -> Column:
        number_bytes = F.ceil(F.length(F.regexp_replace(number, "^0+", "")) / 2)
        payload = number.substr(_LIMBS * 8 - 49, 42)
        checksum = F.lower(number.substr(_LIMBS * 8 - 7, 8))
        expected = F.sha2(F.unhex(F.sha2(F.unhex(payload), 256)), 256).substr(1, 8)
        return (leading_ones + number_bytes == 25) & payload.substr(1, 2).isin("00", "05") & (checksum == expected)

    def as_hex(found: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(_LIMBS - 1)),
            lambda g: F.aggregate(F.slice(found, g * _GROUP + 1, _GROUP), F.lit(0).cast("bigint"), lambda acc, d: acc * 58 + d),
        )
        limbs = F.aggregate(groups, zero, _shift_plus)
        return F.array_join(F.transform(F.reverse(limbs), lambda limb: F.lpad(F.hex(limb), 8, "0")), "")

    valid_digits = bind(digits, lambda d: F.when(~F.exists(d, lambda v: v < 0), as_hex(d)))
    return F.when(
        F.length(address).between(26, 35), F.coalesce(bind(valid_digits, check), F.lit(False))
    ).otherwise(F.lit(False))
