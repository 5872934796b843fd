"""The fact load as one lazy plan over a cleaned feed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafact.config import SourceConfig
from terrafact.functions.rules import field_kinds
from terrafact.operators import dimensions as D
from terrafact.operators import facts as FA
from terrafact.operators import transform as TR
from terrafact.sources.feeds import ROW


class FactLoad(NamedTuple):
    """Frames that a load of one feed yields, all lazy."""

    canonical: DataFrame
    locations: DataFrame
    times: DataFrame
    facts: DataFrame


def link(df: DataFrame, source: SourceConfig, default_country: Column | None = None) -> DataFrame:
    """Transformed rows plus ``location_id``, ``time_id`` and the fact ``id``."""
    kinds = field_kinds(source.by_canonical)
    df = D.resolve_time(D.resolve_location(df, kinds, default_country), kinds)
    return df.withColumn("id", FA.fact_id(source, kinds))


def finish(
    linked: DataFrame,
    source: SourceConfig,
    location: DataFrame,
    time: DataFrame,
    schema: dict[str, str] | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Linked rows as facts: looked-up fields, payload, first row per id."""
    kinds = field_kinds(source.by_canonical)
    rows = FA.resolve_derived(linked, source.derived, location, time)
    rows = FA.collect_payload(rows, kinds, schema or source.schema, source.derived_names, extra)
    keep = [c for c in ("raw_import_id", "ingest_run_id") if c in rows.columns]
    rows = rows.select("id", *keep, "location_id", "time_id", "normalized_data", ROW)
    return rows.withColumn("source_name", F.lit(source.name))


def fact_load(
    feed: DataFrame,
    source: SourceConfig,
    default_country: Column | None = None,
    location: DataFrame | None = None,
    time: DataFrame | None = None,
    schema: dict[str, str] | None = None,
    stale: str = "reject",
    folder: str | None = None,
) -> FactLoad:
    """Plan a load of a cleaned feed into the given dimensions.

    Dimension rows come from every kept row, also from those a look-up drops
    afterwards, and look-ups see the dimensions as merged with them. With a
    folder the linked rows are written there first, so that all that is made
    of them reads the columns it needs instead of the feed again.
    """
    source.validate()
    kinds = field_kinds(source.by_canonical)
    rows = TR.kept_rows(TR.apply_transforms(feed, source))
    rows = TR.check_complete(rows, schema or source.schema, source.derived_names, stale)
    linked = link(rows, source, default_country)
    if folder is not None:
        linked.write.parquet(folder)
        linked = linked.sparkSession.read.schema(linked.schema).parquet(folder)
    locations = D.location_rows(linked, kinds)
    times = D.time_rows(linked, kinds)
    merged_location = D.upsert_location(locations, location) if location is not None else locations
    merged_time = D.upsert_time(times, time) if time is not None else times
    extra = tuple(TR.unmapped_columns(feed, source))
    facts = finish(linked, source, merged_location, merged_time, schema, extra)
    return FactLoad(linked, merged_location, merged_time, facts)
