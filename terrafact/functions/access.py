"""Reading a canonical value as the type a dimension column wants.

The choice depends only on the declared kind, so it is made while the plan is
built; at run time it is a plain expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafact.functions import coerce

SMALL_INTS = ("i8", "i16", "i32", "i64", "u8", "u16")


def as_text(c: Column, kind: str) -> Column:
    return c if kind == "str" else F.lit(None).cast("string")


def as_double(c: Column, kind: str) -> Column:
    if kind in ("f32", "f64"):
        return c.cast("double")
    return coerce.floating(c, "f64") if kind == "str" else F.lit(None).cast("double")


def as_small_int(c: Column, kind: str) -> Column:
    if kind == "str":
        return coerce.signed_int(c, "i16")
    if kind in SMALL_INTS:
        return c.try_cast("smallint")
    return F.lit(None).cast("smallint")


def as_boolean(c: Column, kind: str) -> Column:
    if kind == "bool":
        return c
    return coerce.boolean(c) if kind == "str" else F.lit(None).cast("boolean")


def as_json(c: Column, kind: str) -> Column:
    if kind == "json":
        return c
    return coerce.json_text(c) if kind == "str" else F.lit(None).cast("string")
