"""Spark-native ingest and analytics for place-and-time statistics.

Declarative source definitions turn text feeds into a star schema (facts,
location and time dimensions), entirely as DataFrame plans.
"""

from terrafact.config import (
    ConfigError,
    DerivedDef,
    FieldDef,
    OnFailure,
    RuleDef,
    SourceConfig,
    load_sources,
)

__all__ = [
    "ConfigError",
    "DerivedDef",
    "FieldDef",
    "OnFailure",
    "RuleDef",
    "SourceConfig",
    "load_sources",
]
