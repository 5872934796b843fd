"""Filtered, paged and point reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A named source that is not registered."""


def query_observations(
    fact: DataFrame,
    source_name: str | None = None,
    location_id: str | None = None,
    time_id: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of facts by id. A parameter that is not given adds no predicate."""
    given = {"source_name": source_name, "location_id": location_id, "time_id": time_id}
    for column, value in given.items():
        if value is not None:
            fact = fact.filter(F.col(column) == F.lit(value))
    return fact.orderBy("id").offset(offset).limit(limit)


def observations_after(fact: DataFrame, last_id: str | None, limit: int = 100) -> DataFrame:
    """The page after an id: a filter in place of a growing offset."""
    if last_id is not None:
        fact = fact.filter(F.col("id") > F.lit(last_id))
    return fact.orderBy("id").limit(limit)


def observations_before(fact: DataFrame, first_id: str, limit: int = 100) -> DataFrame:
    """The page in front of an id, in id order."""
    page = fact.filter(F.col("id") < F.lit(first_id)).orderBy(F.col("id").desc()).limit(limit)
    return page.orderBy("id")


def list_locations(location: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of locations by county and zip code; the id makes pages stable."""
    order = [F.asc_nulls_last("county"), F.asc_nulls_last("zip_code"), F.asc("id")]
    return location.orderBy(*order).offset(offset).limit(limit)


def find_by_id(table: DataFrame, key: str) -> DataFrame:
    """The location or time row with an id; no row when there is none."""
    return table.filter(F.col("id") == F.lit(key))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name")


def find_source(sources: DataFrame, name: str) -> dict:
    """A registered source by name; raises NotFound."""
    row = sources.filter(F.col("name") == F.lit(name)).first()
    if row is None:
        raise NotFound(f"no source named {name!r}")
    return row.asDict()
