"""Source definitions: which columns a feed has and what becomes of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

from terrafact.types import DATE_FORMATS, TIMESTAMP_FORMATS, TYPES


class ConfigError(ValueError):
    """A source definition that cannot be run."""


class OnFailure(IntEnum):
    """What a failed rule does; the order of severity is the numeric order."""

    IGNORE = 0
    SKIP_ROW = 1
    SKIP_DATASET = 2

    @classmethod
    def parse(cls, text: str | OnFailure | None) -> OnFailure:
        if text is None:
            return cls.IGNORE
        if isinstance(text, cls):
            return text
        try:
            return cls[str(text).upper()]
        except KeyError:
            raise ConfigError(f"unknown on_failure: {text!r}") from None


DIM_TARGETS = ("dim_location", "dim_time")
RULE_KINDS = ("state_name_to_code", "str_to_bool")
LINK_COLUMNS = ("location_id", "time_id")


@dataclass(frozen=True)
class RuleDef:
    kind: str
    on_failure: OnFailure = OnFailure.IGNORE


@dataclass(frozen=True)
class FieldDef:
    """One feed column: its canonical name, type, format and rules."""

    column: str
    canonical: str
    type: str = "text"
    format: str | None = None
    on_failure: OnFailure = OnFailure.IGNORE
    rules: tuple[RuleDef, ...] = ()

    def policy(self, rule: RuleDef) -> OnFailure:
        return max(self.on_failure, rule.on_failure)


@dataclass(frozen=True)
class DerivedDef:
    """A payload field looked up in a dimension by the row's key."""

    canonical: str
    table: str
    output: str
    match: str | None = None
    type: str = "text"


@dataclass(frozen=True)
class SourceConfig:
    name: str
    fields: tuple[FieldDef, ...] = ()
    derived: tuple[DerivedDef, ...] = ()
    unique_key: tuple[str, ...] = ()
    exclude_columns: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    target: str | None = None
    description: str | None = None
    # "drop" leaves feed columns without a definition out of the payload,
    # "keep" carries them along as text.
    unmapped: str = "drop"
    # None decides per file; False promises that no quoted value spans lines.
    multi_line: bool | None = None
    by_canonical: Mapping[str, FieldDef] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_canonical", {f.canonical: f for f in self.fields})

    @property
    def schema(self) -> dict[str, str]:
        """Canonical name to type string, derived fields included."""
        declared = {f.canonical: f.type for f in self.by_canonical.values()}
        return declared | {d.canonical: d.type for d in self.derived}

    @property
    def derived_names(self) -> set[str]:
        return {d.canonical for d in self.derived}

    def validate(self) -> SourceConfig:
        """Raise ConfigError for anything that would fail on the first row."""
        for f in self.fields:
            if f.type not in TYPES:
                raise ConfigError(f"unknown field type: {f.type!r}")
            if f.format is not None:
                formats = {"date": DATE_FORMATS, "timestamp": TIMESTAMP_FORMATS}.get(
                    TYPES[f.type].kind
                )
                if formats is None:
                    raise ConfigError(f"a format needs a date or timestamp type, not {f.type!r}")
                if f.format not in formats:
                    raise ConfigError(f"unknown {f.type} format: {f.format!r}")
            for r in f.rules:
                if r.kind not in RULE_KINDS:
                    raise ConfigError(f"unknown rule kind: {r.kind!r} on {f.canonical!r}")
        known = {*self.by_canonical, *self.derived_names, *LINK_COLUMNS}
        for name in self.unique_key:
            if name not in known:
                raise ConfigError(
                    f"unique_key: {name!r} is not a declared field of source {self.name!r}"
                )
        if self.unmapped not in ("drop", "keep"):
            raise ConfigError(f"unmapped must be 'drop' or 'keep', not {self.unmapped!r}")
        if self.target is not None and self.target not in DIM_TARGETS:
            raise ConfigError(f"unknown target: {self.target!r}")
        return self

    def validate_columns(self, columns: Iterable[str]) -> None:
        """Every excluded column must exist in the feed."""
        have = {c.lower() for c in columns}
        for name in self.exclude_columns:
            if name.lower() not in have:
                raise ConfigError(
                    f"exclude_columns: {name!r} is not a column of source {self.name!r}"
                )

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> SourceConfig:
        fields = tuple(
            FieldDef(
                column=str(column),
                canonical=spec["canonical"],
                type=spec.get("type", "text"),
                format=spec.get("format"),
                on_failure=OnFailure.parse(spec.get("on_failure")),
                rules=tuple(
                    RuleDef(r["kind"], OnFailure.parse(r.get("on_failure")))
                    for r in spec.get("rules") or ()
                ),
            )
            for column, spec in (d.get("fields") or {}).items()
        )
        derived = tuple(
            DerivedDef(
                canonical=name,
                table=spec["from"],
                output=spec["output"],
                match=spec.get("match"),
                type=spec.get("type", "text"),
            )
            for name, spec in (d.get("derived") or {}).items()
        )
        return cls(
            name=d["name"],
            fields=fields,
            derived=derived,
            unique_key=tuple(d.get("unique_key") or ()),
            exclude_columns=tuple(d.get("exclude_columns") or ()),
            files=tuple(d.get("files") or ()),
            target=d.get("target"),
            description=d.get("description"),
            unmapped=d.get("unmapped", "drop"),
            multi_line=d.get("multi_line"),
        )


def load_sources(text: str, dimensions: bool = False) -> list[SourceConfig]:
    """Parse a YAML document with a top-level ``sources`` list."""
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs the yaml module; use SourceConfig.from_dict") from e
    doc = yaml.safe_load(text) or {}
    sources = [SourceConfig.from_dict(d).validate() for d in doc.get("sources") or ()]
    if dimensions:
        for s in sources:
            if s.target is None:
                raise ConfigError(f"dimension source {s.name!r} has no target")
    return sources
