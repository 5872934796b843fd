"""Cleaning rules and the chain of steps a field goes through."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafact.config import FieldDef, OnFailure
from terrafact.functions import coerce
from terrafact.functions.places import state_code
from terrafact.types import KIND_TYPES, TYPES


class Step(NamedTuple):
    """One step of a chain: null out of a non-null input means failure."""

    apply: Callable[[Column], Column]
    policy: OnFailure


def _nothing(kind: str) -> Callable[[Column], Column]:
    """For a step that cannot take the kind it is given: it always fails."""
    return lambda c: F.lit(None).cast(KIND_TYPES[kind])


def _rule(name: str, kind: str) -> tuple[Callable[[Column], Column], str]:
    if name == "state_name_to_code":
        return (state_code, "str") if kind == "str" else (_nothing("str"), "str")
    if name == "str_to_bool":
        if kind == "bool":
            return (lambda c: c), "bool"
        return (coerce.boolean, "bool") if kind == "str" else (_nothing("bool"), "bool")
    raise ValueError(f"unknown rule kind: {name!r}")


def chain(field: FieldDef) -> tuple[list[Step], str]:
    """Steps of a field, the declared type's coercion last, and the final kind."""
    steps, kind = [], "str"
    for rule in field.rules:
        apply, kind = _rule(rule.kind, kind)
        steps.append(Step(apply, field.policy(rule)))
    want = TYPES[field.type].kind
    if want != "str":
        # Coercions read text only, so a typed value in front of one fails.
        apply = (
            (lambda c: coerce.coerce(c, want, field.format)) if kind == "str" else _nothing(want)
        )
        steps.append(Step(apply, field.on_failure))
        kind = want
    return steps, kind


def field_kinds(fields: dict[str, FieldDef]) -> dict[str, str]:
    """Final kind of every canonical field."""
    return {name: chain(f)[1] for name, f in fields.items()}
