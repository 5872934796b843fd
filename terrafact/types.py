"""Declared field types, value kinds and table schemas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class FieldType(NamedTuple):
    kind: str
    export: str | None


# Type strings, the value kind each yields, and the type the
# export casts it to (None leaves text).
TYPES = {
    "text": FieldType("str", None),
    "varchar": FieldType("str", None),
    "char": FieldType("str", None),
    "smallint": FieldType("i16", "smallint"),
    "int2": FieldType("i16", None),
    "integer": FieldType("i32", "int"),
    "int": FieldType("i32", "int"),
    "int4": FieldType("i32", None),
    "bigint": FieldType("i64", "bigint"),
    "int8": FieldType("i64", None),
    "real": FieldType("f32", "float"),
    "float4": FieldType("f32", "float"),
    "float8": FieldType("f64", "double"),
    "double precision": FieldType("f64", "double"),
    "numeric": FieldType("f64", "double"),
    "decimal": FieldType("f64", None),
    "boolean": FieldType("bool", "boolean"),
    "bool": FieldType("bool", None),
    "jsonb": FieldType("json", None),
    "json": FieldType("json", None),
    "date": FieldType("date", "date"),
    "timestamptz": FieldType("timestamp", "timestamp"),
    "timestamp with time zone": FieldType("timestamp", None),
    "i8": FieldType("i8", None),
    "i16": FieldType("i16", None),
    "i32": FieldType("i32", None),
    "i64": FieldType("i64", None),
    "u8": FieldType("u8", None),
    "u16": FieldType("u16", None),
    "u32": FieldType("u32", None),
    "u64": FieldType("u64", None),
    "f32": FieldType("f32", None),
    "f64": FieldType("f64", None),
}

# Format names of date and timestamp fields; the first is the default.
DATE_FORMATS = ("iso8601", "month_day_year", "day_month_year", "year_month_day", "long_us")
TIMESTAMP_FORMATS = ("rfc3339", "rfc2822", "unix_seconds", "unix_millis", "us_datetime")

# Spark type that holds each kind of value.
KIND_TYPES: dict[str, T.DataType] = {
    "str": T.StringType(),
    "json": T.StringType(),
    "bool": T.BooleanType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}

# Names kept out of the payload because the dimensions hold them.
LOCATION_FIELDS = (
    "county",
    "country",
    "zip_code",
    "fips_code",
    "latitude",
    "longitude",
    "state_code",
    "state_name",
)
TIME_FIELDS = ("year", "quarter", "month", "day")
DIMENSION_FIELDS = frozenset(LOCATION_FIELDS + TIME_FIELDS)

# Columns that make up the key of each dimension.
LOCATION_KEY = ("city", "country", "fips_code", "state_code", "zip_code")
TIME_KEY = ("day", "month", "quarter", "year")

_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "smallint": T.ShortType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _table(columns: str) -> T.StructType:
    """A schema from ``name type, ...``, without the need of a session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOCATION_SCHEMA = _table(
    "id string, county string, country string, zip_code string, fips_code string, "
    "latitude double, longitude double, city string, state_code string, state_name string, "
    "zcta string, parent_zcta string, population double, density double, "
    "county_weights string, county_names_all string, county_fips_all string, "
    "imprecise boolean, military boolean, timezone string"
)
TIME_SCHEMA = _table(
    "id string, year smallint, quarter smallint, month smallint, day smallint, date_floor date"
)
FACT_SCHEMA = _table(
    "id string, raw_import_id bigint, location_id string, time_id string, "
    "normalized_data string, inserted_at timestamp, source_name string, ingest_run_id string"
)
RAW_SCHEMA = _table(
    "raw_import_id bigint, source_id bigint, source_file string, raw_data string, "
    "imported_at timestamp, source_name string, ingest_run_id string"
)
FIELD_REGISTRY_SCHEMA = _table(
    "source_name string, field_name string, field_type string, description string, "
    "created_at timestamp"
)
SOURCE_REGISTRY_SCHEMA = _table(
    "id string, name string, description string, created_at timestamp"
)
RUN_LOG_SCHEMA = _table(
    "source_name string, source_file string, ingest_run_id string, status string, "
    "logged_at timestamp"
)
DIM_LOG_SCHEMA = _table(
    "id string, source_name string, target string, file_path string, "
    "persisted_at timestamp, row_count bigint"
)
