"""Reading the JSON payload of fact rows: fields, containment, tall form, context."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafact.functions import coerce

PAYLOAD = "normalized_data"


def parsed(fields: Iterable[str], payload: str = PAYLOAD) -> Column:
    """The named payload fields as a struct of texts, in one pass over the JSON."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return F.from_json(payload, schema)


def as_map(payload: str = PAYLOAD) -> Column:
    return F.from_json(payload, T.MapType(T.StringType(), T.StringType()))


def payload_field(df: DataFrame, key: str, spark_type: str = "string", name: str | None = None):
    """Add one payload field, cast; text that does not fit the type is null."""
    value = parsed([key])[key]
    return df.withColumn(name or key, value if spark_type == "string" else value.try_cast(spark_type))


def member(doc: Column | str, key: str, spark_type: str = "variant") -> Column:
    """A field of a variant object; null where there is none, or where it does not fit the type."""
    for quote in "\"'":
        if quote not in key:  # paths know no escapes
            return F.try_variant_get(doc, f"$[{quote}{key}{quote}]", spark_type)
    found = F.try_variant_get(doc, "$", "map<string,variant>")[key]
    return found if spark_type == "variant" else F.try_variant_get(found, "$", spark_type)


def payload_contains(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows whose payload has all the given field values, by type and value.

    A text is not the number it spells; numbers are equal by value, however
    written; lists and objects are compared whole, whatever the order of members.
    """
    doc = F.try_parse_json(PAYLOAD)
    test = F.lit(True)
    for key, value in values.items():
        found = member(doc, key)
        kind = F.schema_of_variant(found)
        if value is None:
            same = F.is_variant_null(found)
        elif isinstance(value, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(value))
        elif isinstance(value, int | float | Decimal):
            number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            exact = "decimal(38,18)" if not isinstance(value, float) and abs(value) < 10**20 else "double"
            same = number & (F.try_variant_get(found, "$", exact) == F.lit(str(value)).cast(exact))
        elif isinstance(value, str):
            same = (kind == "STRING") & (F.try_variant_get(found, "$", "string") == F.lit(value))
        else:
            same = F.to_json(found) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
        test = test & F.coalesce(same, F.lit(False))
    return df.filter(test)


def to_observations(fact: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row per fact and payload field: ``metric_name`` and a number or null.

    Without ``fields`` every field of every payload is taken. With the fields
    of a source, each gives one row per fact, and only those are parsed.
    """
    rest = [c for c in fact.columns if c != PAYLOAD]
    if fields is None:
        pairs = F.map_entries(as_map())
        tall = fact.select(*rest, F.inline(pairs).alias("metric_name", "text"))
    else:
        fields = list(fields)
        values = fact.select(*rest, parsed(fields).alias("_p"))
        pairs = F.array(
            *[F.struct(F.lit(f).alias("n"), F.col("_p")[f].alias("v")) for f in fields]
        )
        tall = values.select(*rest, F.inline(pairs).alias("metric_name", "text"))
    number = coerce.floating(F.col("text"), "f64")
    return tall.select(*rest, "metric_name", number.alias("metric_value"))


def filter_metric(tall: DataFrame, name: str = "") -> DataFrame:
    """Observations of one metric; the empty name means all."""
    return tall.filter(F.col("metric_name") == name) if name else tall


def extract_context(fact: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Add ``attributes``: the payload fields that are not numbers, as JSON.

    Naming the source's fields spares building a map per row.
    """
    if fields is None:
        kept = F.map_filter(
            as_map(), lambda _, v: v.isNotNull() & coerce.floating(v, "f64").isNull()
        )
        entries = F.map_from_entries(F.array_sort(F.map_entries(kept)))
        return fact.withColumn("attributes", F.to_json(entries))
    names = sorted(fields)
    values = fact.withColumn("_p", parsed(names))
    # Null members are left out of the JSON.
    texts = [
        F.when(coerce.floating(F.col("_p")[n], "f64").isNull(), F.col("_p")[n]).alias(n)
        for n in names
    ]
    return values.withColumn("attributes", F.to_json(F.struct(*texts))).drop("_p")
