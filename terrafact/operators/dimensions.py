"""Location and time: keys of fact rows, dimension rows, upserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafact.functions import access
from terrafact.functions.keys import joined_key, key_text, uuid5
from terrafact.functions.places import date_floor, within
from terrafact.functions.text import quoted
from terrafact.operators.keep import first_per_key, folded, last_per_key, upsert
from terrafact.sources.feeds import POSITION, ROW
from terrafact.types import LOCATION_KEY, LOCATION_SCHEMA, TIME_KEY, TIME_SCHEMA

Kinds = Mapping[str, str]

# Location columns a fact feed can fill; only dimension feeds fill the others.
# Column names.
FACT_LOCATION_COLUMNS = (
    "county",
    "country",
    "zip_code",
    "fips_code",
    "latitude",
    "longitude",
    "city",
    "state_code",
    "state_name",
    "timezone",
)
# The country a row's file stands for, while the row is linked.
COUNTRY = "_country"

# A row with none of these names no place.
# Column names.
PLACE_COLUMNS = ("county", "country", "zip_code", "fips_code")

_READERS = {"string": access.as_text, "double": access.as_double, "boolean": access.as_boolean}


def _attribute(kinds: Kinds, name: str) -> Column:
    """A canonical field as its location column's type; absent is null."""
    spark_type = LOCATION_SCHEMA[name].dataType.simpleString()
    if name not in kinds:
        return F.lit(None).cast(spark_type)
    reader = access.as_json if name == "county_weights" else _READERS[spark_type]
    return reader(quoted(name), kinds[name])


def _key(names: tuple[str, ...], kinds: Kinds, overrides: Mapping[str, Column] | None = None):
    texts = {n: key_text(quoted(n), kinds[n]) for n in names if n in kinds}
    texts.update(overrides or {})
    return joined_key((n, texts.get(n, F.lit(""))) for n in names)


def _country(kinds: Kinds, default: Column | None) -> tuple[Column, Column]:
    """Country as the dimension stores it and as the key spells it."""
    stored = _attribute(kinds, "country")
    spelt = key_text(quoted("country"), kinds["country"]) if "country" in kinds else F.lit("")
    if default is None:
        return stored, spelt
    given = quoted("country").isNotNull() if "country" in kinds else F.lit(False)
    return F.coalesce(stored, default), F.when(given, spelt).otherwise(F.coalesce(default, F.lit("")))


def resolve_location(df: DataFrame, kinds: Kinds, default_country: Column | None = None) -> DataFrame:
    """Add ``location_id``; null for a row that names no place.

    The key is a function of the row, so no look-up join is needed.
    """
    if default_country is not None:
        # In a column of its own, so that it is worked out once per row.
        df = df.withColumn(COUNTRY, default_country)
        default_country = F.col(COUNTRY)
    country, spelt = _country(kinds, default_country)
    parts = [country if n == "country" else _attribute(kinds, n) for n in PLACE_COLUMNS]
    named = F.coalesce(*parts).isNotNull()
    text = F.concat(F.when(named, F.lit("")), _key(LOCATION_KEY, kinds, {"country": spelt}))
    return df.withColumn("location_id", uuid5(text))


def location_rows(df: DataFrame, kinds: Kinds) -> DataFrame:
    """Dimension rows of resolved fact rows: the first row per key wins."""
    country, _ = _country(kinds, F.col(COUNTRY) if COUNTRY in df.columns else None)
    filled = {n: _attribute(kinds, n) for n in FACT_LOCATION_COLUMNS} | {"country": country}
    rows = df.filter(F.col("location_id").isNotNull()).select(
        F.col("location_id").alias("id"),
        *[c.alias(n) for n, c in filled.items()],
        F.col(ROW),
    )
    return _shape_location(first_per_key(folded(rows, ROW), "id", ROW))


def versions(rows: DataFrame, existing: DataFrame, merge: str = "replace") -> DataFrame:
    """What a dimension holds for a key once each of a load's files is merged.

    ``rows`` are dimension rows with ``_position`` (of their file) and
    ``_row``. The result has one row per key and file that names it, so a
    look-up by key and position gives what loading file by file would.
    """
    names = existing.columns
    file_key = F.concat_ws("#", "id", POSITION)
    own = first_per_key(rows.withColumn("_version", file_key), "_version", ROW).select(*names, POSITION)
    if merge == "replace":
        return own
    known = existing.join(own.select("id"), "id", "left_semi").withColumn(POSITION, F.lit(-1))
    so_far = Window.partitionBy("id").orderBy(POSITION)
    filled = own.unionByName(known).select(
        "id", POSITION, *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in names if c != "id"]
    )
    return filled.filter(F.col(POSITION) >= 0).select(*names, POSITION)


def location_versions(df: DataFrame, kinds: Kinds, existing: DataFrame, merge: str) -> DataFrame:
    country, _ = _country(kinds, F.col(COUNTRY) if COUNTRY in df.columns else None)
    filled = {n: _attribute(kinds, n) for n in FACT_LOCATION_COLUMNS} | {"country": country}
    rows = df.filter(F.col("location_id").isNotNull()).select(
        F.col("location_id").alias("id"),
        *[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION_SCHEMA if f.name != "id"],
        POSITION, ROW,
    )
    return versions(rows, existing, merge)


def time_versions(df: DataFrame, kinds: Kinds, existing: DataFrame) -> DataFrame:
    parts = df.filter(F.col("time_id").isNotNull()).select(
        F.col("time_id").alias("id"), *[c.alias(n) for n, c in _calendar(kinds).items()], POSITION, ROW
    )
    floor = date_floor(F.col("year"), F.col("quarter"), F.col("month"), F.col("day"))
    return versions(parts.withColumn("date_floor", floor), existing)


def _shape_location(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in LOCATION_SCHEMA
        ]
    )


def _calendar(kinds: Kinds) -> dict[str, Column]:
    def part(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("smallint")
        return access.as_small_int(quoted(name), kinds[name])

    return {
        "year": part("year"),
        "quarter": within(part("quarter"), 1, 4),
        "month": within(part("month"), 1, 12),
        "day": within(part("day"), 1, 31),
    }


def resolve_time(df: DataFrame, kinds: Kinds) -> DataFrame:
    """Add ``time_id``, null without a year; the key spells the parts as given."""
    year = _calendar(kinds)["year"]
    text = F.concat(F.when(year.isNotNull(), F.lit("")), _key(TIME_KEY, kinds))
    return df.withColumn("time_id", uuid5(text))


def _time_frame(df: DataFrame, key: Column, kinds: Kinds) -> DataFrame:
    parts = df.select(
        key.alias("id"), *[c.alias(n) for n, c in _calendar(kinds).items()], F.col(ROW)
    )
    return parts.filter(F.col("id").isNotNull())


def with_date_floor(df: DataFrame) -> DataFrame:
    """Time rows in table shape, ``date_floor`` computed from the parts."""
    floor = date_floor(F.col("year"), F.col("quarter"), F.col("month"), F.col("day"))
    return df.withColumn("date_floor", floor).select(*TIME_SCHEMA.names)


def time_rows(df: DataFrame, kinds: Kinds) -> DataFrame:
    """Dimension rows of a fact feed with ``time_id``."""
    return with_date_floor(first_per_key(folded(_time_frame(df, F.col("time_id"), kinds), ROW), "id", ROW))


def row_key(names: tuple[str, ...], kinds: Kinds) -> Column:
    """Key of a row over the named canonical fields; random without any."""
    if not names:
        return F.uuid()
    return uuid5(joined_key((n, key_text(quoted(n), kinds[n]) if n in kinds else F.lit("")) for n in names))


def location_load_rows(df: DataFrame, kinds: Kinds, unique_key: tuple[str, ...]) -> DataFrame:
    """Rows of a location feed; the last row per key wins."""
    filled = {n: _attribute(kinds, n) for n in LOCATION_SCHEMA.names if n != "id"}
    rows = df.select(
        row_key(unique_key, kinds).alias("id"),
        *[c.alias(n) for n, c in filled.items()],
        F.col(ROW),
    )
    if not unique_key:
        return _shape_location(rows)
    return _shape_location(last_per_key(rows, "id", ROW))


def time_load_rows(df: DataFrame, kinds: Kinds, unique_key: tuple[str, ...]) -> DataFrame:
    """Rows of a calendar feed; the last row per key wins. A row without a year fails the load."""
    rows = _time_frame(df, row_key(unique_key, kinds), kinds)
    rows = rows.withColumn(
        "year",
        F.coalesce(
            F.col("year"), F.raise_error(F.lit("year is missing or invalid")).cast("smallint")
        ),
    )
    if unique_key:
        rows = last_per_key(rows, "id", ROW)
    return with_date_floor(rows)


def upsert_location(new: DataFrame, existing: DataFrame, merge: str = "replace") -> DataFrame:
    """Merge location rows into the dimension.

    ``replace`` overwrites the whole row, so that a fact load, which knows no
    population or density, erases them; ``coalesce`` keeps what was known.
    """
    return upsert(new, existing, merge)


def upsert_time(new: DataFrame, existing: DataFrame) -> DataFrame:
    return upsert(new, existing)
