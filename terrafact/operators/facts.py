"""Fact rows: enrichment from the dimensions, payload, keys, raw audit rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafact.config import ConfigError, DerivedDef, SourceConfig
from terrafact.functions.keys import joined_key, key_text, uuid5
from terrafact.functions.text import finite, quoted, utc_text
from terrafact.operators.keep import first_per_key
from terrafact.sources.feeds import POSITION, ROW, feed_columns, meta_columns
from terrafact.types import DIMENSION_FIELDS

# Prefix of looked-up values while they travel next to the canonical fields.
DERIVED = "_derived_"
KEEP_NULLS = {"ignoreNullFields": "false"}


def raw_json(df: DataFrame) -> Column:
    """A cleaned feed row as one JSON object, blanks as explicit nulls."""
    return F.to_json(F.struct(*[quoted(c) for c in sorted(feed_columns(df))]), KEEP_NULLS)


def raw_rows(df: DataFrame) -> DataFrame:
    """Audit rows of a cleaned feed: the row as JSON, and where it came from."""
    return df.select(raw_json(df).alias("raw_data"), *meta_columns(df))


def read_raw(raw: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Audit rows back as feed columns, ready for the transforms."""
    schema = ", ".join(f"`{c.lower()}` string" for c in sorted(set(columns)))
    parsed = raw.select(
        F.from_json("raw_data", schema).alias("r"),
        F.col("source_file").alias("_file"),
        F.col("raw_import_id").alias(ROW),
        F.col("ingest_run_id"),
    )
    return parsed.select("r.*", "_file", ROW, "ingest_run_id")


def resolve_derived(
    df: DataFrame, derived: Iterable[DerivedDef], location: DataFrame, time: DataFrame
) -> DataFrame:
    """Look derived fields up by the row's dimension keys; rows without a value go.

    One equi-join per dimension, whatever the number of fields; Spark chooses
    its strategy from the dimension's size. Only text columns can be looked up.
    """
    tables = {"dim_location": (location, "location_id"), "dim_time": (time, "time_id")}
    wanted: dict[str, list[DerivedDef]] = {}
    for d in derived:
        if d.table not in tables:
            warnings.warn(f"derived field {d.canonical!r}: unsupported table {d.table!r}", stacklevel=2)
            return df.filter(F.lit(False))
        wanted.setdefault(d.table, []).append(d)
    for table, fields in wanted.items():
        dim, key = tables[table]
        texts = [
            d for d in fields if d.output in dim.columns and dict(dim.dtypes)[d.output] == "string"
        ]
        if len(texts) < len(fields):
            warnings.warn(f"derived fields of {table} need text columns", stacklevel=2)
            return df.filter(F.lit(False))
        # A dimension with positions holds a version of each row for each file.
        keys = [key, POSITION] if POSITION in dim.columns else [key]
        found = dim.withColumnRenamed("id", key).select(
            *keys, *[F.col(d.output).alias(DERIVED + d.canonical) for d in fields]
        )
        # A row without a match or with a null value is dropped, which makes
        # this an inner join over the dimension rows that have every value.
        df = df.join(found.dropna(), keys, "inner")
    return df


def _json_value(c: Column, kind: str) -> Column:
    if kind in ("f32", "f64"):
        return finite(c)
    if kind == "timestamp":
        return utc_text(c)
    if kind == "json":
        return F.try_parse_json(c)
    return c


def collect_payload(
    df: DataFrame,
    kinds: Mapping[str, str],
    schema: Mapping[str, str],
    derived: Iterable[str] = (),
    extra: Iterable[str] = (),
) -> DataFrame:
    """Add ``normalized_data``: registered fields as JSON, dimension fields left out."""
    derived = set(derived)
    values: dict[str, Column] = {}
    for name in schema:
        if name in DIMENSION_FIELDS and name not in derived:
            continue
        if name in derived:
            values[name] = quoted(DERIVED + name)
        elif name in kinds:
            values[name] = _json_value(quoted(name), kinds[name])
        else:
            values[name] = F.lit(None).cast("string")
    values |= {n: quoted(n) for n in extra}
    if not values:
        return df.withColumn("normalized_data", F.lit("{}"))
    payload = F.struct(*[values[n].alias(n) for n in sorted(values)])
    return df.withColumn("normalized_data", F.to_json(payload, KEEP_NULLS))


def fact_id(source: SourceConfig, kinds: Mapping[str, str]) -> Column:
    """Key of a fact row; looked-up fields are not part of it and read as empty."""
    if not source.unique_key:
        return F.uuid()
    parts = []
    for name in source.unique_key:
        if name in ("location_id", "time_id"):
            parts.append((name, F.col(name)))
        elif name in kinds:
            parts.append((name, key_text(quoted(name), kinds[name])))
        elif name in source.derived_names:
            parts.append((name, F.lit("")))
        else:
            raise ConfigError(f"unique_key: {name!r} is not a declared field")
    # Never null. Said so that Spark sees it, no filter works the key out a second time.
    return F.coalesce(uuid5(joined_key(parts)), F.lit(""))


def append_facts(new: DataFrame, existing: DataFrame, order: str = ROW) -> DataFrame:
    """Rows to add: the first row per id, unless the id is already loaded.

    ``new`` is the plan of a whole load, whose rows are dear to make: they are made once, and dealt
    by id as their de-duplication needs it anyway, so that only the ids of ``existing`` move besides.
    """
    return first_per_key(new, "id", order).join(existing.select("id"), "id", "left_anti")
