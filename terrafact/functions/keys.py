"""Deterministic row keys: name-based UUIDs over canonical values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafact.functions.text import utc_text

# Fixed value: the OID name space of RFC 4122, as hex digits.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def float_bits(c: Column, kind: str) -> Column:
    """IEEE bits of a float as an unsigned decimal number in text."""
    if kind == "f32":
        method, span = ("java.lang.Float", "floatToRawIntBits"), 2**32
    else:
        method, span = ("java.lang.Double", "doubleToRawLongBits"), 2**64
    bits = F.reflect(F.lit(method[0]), F.lit(method[1]), c).cast("decimal(21,0)")
    shift = F.lit(str(span)).cast("decimal(21,0)")
    return F.when(bits < 0, bits + shift).otherwise(bits).cast("decimal(20,0)").cast("string")


def key_text(c: Column, kind: str) -> Column:
    """How a value is written inside a key; null is empty."""
    if kind in ("f32", "f64"):
        text = F.when(c.isNotNull(), float_bits(c, kind))
    elif kind == "timestamp":
        text = utc_text(c)
    elif kind == "json":
        text = F.to_json(F.try_parse_json(c))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def joined_key(parts: Iterable[tuple[str, Column]]) -> Column:
    """``name=text`` pairs in name order, joined by a bar."""
    ordered = sorted(parts, key=lambda p: p[0])
    return F.concat_ws(
        "|", *[F.concat(F.lit(name + "="), F.coalesce(text, F.lit(""))) for name, text in ordered]
    )


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a text in the OID name space; null stays null.

    Null runs through the whole expression instead of a condition around it,
    so that the digest is computed once per row.
    """
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(name, "UTF-8")))
    dash = F.lit("-")
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        dash,
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        dash,
        variant,
        F.substring(digest, 18, 3),
        dash,
        F.substring(digest, 21, 12),
    )
