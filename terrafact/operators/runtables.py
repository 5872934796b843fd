"""What is kept of each run beside its facts: parsed payloads, postings of payload terms, partial sums.

Each function makes its rows from fact rows alone, so they can be made again for any run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafact.functions import coerce
from terrafact.operators.payload import PAYLOAD, member, payload_contains, to_observations
from terrafact.sources.derived import RunTable
from terrafact.types import FACT_SCHEMA

RUN = ["source_name", "ingest_run_id"]
# Texts up to so many bytes are a posting's value as they are, others by their md5.
TERM_BYTES = 64
# Numbers nearer to zero are looked up without their value: their decimals round away.
TINY = 1e-9


def _schema(columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "variant": T.VariantType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in columns.split(","))])


_RUN_COLUMNS = ", source_name string, ingest_run_id string"

# --- payloads as variants -----------------------------------------------------------------


def fact_values(fact: DataFrame) -> DataFrame:
    """Facts with their payload parsed once. Parquet stores a field that most rows have as a
    column of its own, so that a reader of one field reads that column only."""
    return fact.select("id", "location_id", "time_id", F.try_parse_json(PAYLOAD).alias("payload"), *RUN)


def _value(key: str, spark_type: str, payload: str = "payload") -> Column:
    # The scan is asked for the field as it is: its own casts exist as generated code only.
    return F.try_variant_get(member(payload, key), "$", spark_type)


def value_text(key: str, payload: str = "payload") -> Column:
    """A field as text; lists and objects as JSON."""
    nested = member(payload, key)
    return F.coalesce(_value(key, "string", payload), F.when(~F.is_variant_null(nested), F.to_json(nested)))


def value_texts(fields: Iterable[str], payload: str = "payload") -> Column:
    """The named fields as a struct of texts, as ``payload.parsed`` gives it from JSON."""
    return F.struct(*[value_text(f, payload).alias(f) for f in fields])


def value_field(values: DataFrame, key: str, spark_type: str = "string", name: str | None = None) -> DataFrame:
    """Add one payload field, cast; a value that does not fit the type is null."""
    return values.withColumn(name or key, _value(key, spark_type))


def value_observations(values: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row per fact and field: ``metric_name`` and a number or null."""
    rest = [c for c in values.columns if c != "payload"]
    fields = list(fields)
    # Texts and numbers are columns of their own: inside the generator, or of each other, each use of a
    # text would read the payload again.
    texts = values.select(*rest, *[_value(f, "string").alias(f"_t{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f).alias("n"), F.col(f"_t{i}").alias("v")) for i, f in enumerate(fields)])
    tall = texts.select(*rest, F.inline(pairs).alias("metric_name", "_text"))
    return tall.select(*rest, "metric_name", coerce.floating(F.col("_text"), "f64").alias("metric_value"))


# --- postings -----------------------------------------------------------------------------


def _number(text: Column) -> Column:
    """One spelling for equal numbers."""
    return (text + F.lit(0.0)).cast("string")


def payload_terms(fact: DataFrame) -> DataFrame:
    """One row for each field of each payload: its name, the kind of its value and the value."""
    parsed = fact.select("id", *RUN, F.try_parse_json(PAYLOAD).alias("_p"))
    # A payload that is a list or a plain value has no fields.
    members = F.map_entries(F.try_variant_get("_p", "$", "map<string,variant>"))
    fields = parsed.select("id", *RUN, F.inline(members).alias("name", "_v"))
    shape = F.schema_of_variant("_v")
    number = F.coalesce(F.try_variant_get("_v", "$", "decimal(38,18)").cast("double"), F.try_variant_get("_v", "$", "double"))
    text = F.try_variant_get("_v", "$", "string")
    kind = (
        F.when(F.col("_v").isNull() | F.is_variant_null("_v"), "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(shape == "STRING", "string")
        .otherwise("other")
    )
    kept = F.when(F.octet_length(text) <= TERM_BYTES, text).otherwise(F.concat(F.lit("md5:"), F.md5(text)))
    value = (
        F.when(F.col("kind") == "null", F.lit(""))
        .when(F.col("kind") == "number", _number(number))
        .when(F.col("kind") == "other", F.md5(F.to_json("_v")))
        .when(F.col("kind") == "boolean", text)
        .otherwise(kept)
    )
    terms = fields.withColumn("kind", kind)
    return terms.select("name", "kind", value.alias("value"), "id", *RUN)


def _term(key: str, value: object) -> Column:
    """Postings of a field that equals a value: all of them, and few others."""
    c = F.col("name") == F.lit(key)
    if value is None:
        return c & (F.col("kind") == "null")
    if isinstance(value, bool):
        return c & (F.col("kind") == "boolean") & (F.col("value") == F.lit(str(value).lower()))
    if isinstance(value, int | float | Decimal):
        c = c & (F.col("kind") == "number")
        if abs(value) < TINY:
            return c
        spelt = F.coalesce(F.lit(str(value)).try_cast("decimal(38,18)").cast("double"), F.lit(str(value)).cast("double"))
        return c & (F.col("value") == _number(spelt))
    if isinstance(value, str):
        kept = F.lit(value) if len(value.encode()) <= TERM_BYTES else F.concat(F.lit("md5:"), F.md5(F.lit(value)))
        return c & (F.col("kind") == "string") & (F.col("value") == kept)
    return c & (F.col("kind") == "other") & (F.col("value") == F.md5(F.to_json(F.parse_json(F.lit(json.dumps(value))))))


def term_hits(terms: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Run and id of the facts that have all the terms."""
    tests = {k: _term(k, v) for k, v in values.items()}
    any_of = None
    for test in tests.values():
        any_of = test if any_of is None else any_of | test
    which = F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(tests.values())])
    found = terms.filter(any_of).select(*RUN, "id", which.alias("_i"))
    if len(tests) == 1:
        return found.select(*RUN, "id").distinct()
    each = found.groupBy(*RUN, "id").agg(F.count_distinct("_i").alias("_n"))
    return each.filter(F.col("_n") == len(tests)).select(*RUN, "id")


def contains_by_terms(fact: DataFrame, terms: DataFrame, values: Mapping[str, object], most_runs: int = 10_000) -> DataFrame:
    """``payload_contains`` from the postings: payloads are read only in runs that have the terms,
    and looked at once more, as postings of long or odd values say a little too much."""
    if not values:
        return fact
    columns = fact.columns
    hits = term_hits(terms, values)
    runs = [r[0] for r in hits.select("ingest_run_id").distinct().limit(most_runs + 1).collect()]
    if len(runs) <= most_runs:  # beyond that, the join alone decides
        fact = fact.filter(F.col("ingest_run_id").isin(runs))
    return payload_contains(fact.join(hits, [*RUN, "id"], "left_semi").select(*columns), values)


# --- partial sums -------------------------------------------------------------------------


def metric_partials(fact: DataFrame) -> DataFrame:
    """For each run, and once for each place and once for each period of it: rows, values, sum, least and most of
    every metric. ``axis`` says whether ``key`` is a place or a period."""
    tall = to_observations(fact.select("location_id", "time_id", PAYLOAD, *RUN))
    value = F.col("metric_value")
    one = tall.groupBy(*RUN, "location_id", "time_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n"), F.sum(value).alias("total"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )
    axes = F.array(
        F.struct(F.lit("location_id").alias("axis"), F.col("location_id").alias("key")),
        F.struct(F.lit("time_id").alias("axis"), F.col("time_id").alias("key")),
    )
    return (
        one.select(*RUN, "metric_name", "n_rows", "n", "total", "least", "most", F.inline(axes).alias("axis", "key"))
        .groupBy(*RUN, "axis", "key", "metric_name")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("total").alias("total"),
             F.min("least").alias("least"), F.max("most").alias("most"))
    )


# --- distinct counts ----------------------------------------------------------------------


def _combos(fact: DataFrame) -> DataFrame:
    """How many observations each run has of each place and metric."""
    names = F.explode(F.json_object_keys(PAYLOAD)).alias("metric_name")
    tall = fact.select(*RUN, "location_id", names)
    return tall.groupBy(*RUN, "location_id", "metric_name").agg(F.count(F.lit(1)).alias("n"))


_AXES = {"source_name": "source_name", "location_id": "location_id", "metric_name": "metric_name"}


def _axis_keys(combos: DataFrame, *columns: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("key")) for a, c in _AXES.items()])
    return combos.select(*columns, F.inline(pairs).alias("axis", "key")).filter(F.col("key").isNotNull())


def counted_keys(fact: DataFrame) -> DataFrame:
    """The sources, places and metrics of facts, to be numbered."""
    return _axis_keys(_combos(fact))


def key_bitmaps(fact: DataFrame, numbers: DataFrame) -> DataFrame:
    """For each run and axis (source, place, metric) the set of its keys as bitmaps over their numbers,
    32,768 a row; and on the axis ``rows`` how many observations there are."""
    combos = _combos(fact)
    keyed = _axis_keys(combos, *RUN).join(numbers, ["axis", "key"])
    sets = keyed.groupBy(*RUN, "axis", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    rows = combos.groupBy(*RUN).agg(F.sum("n").alias("n"))
    rows = rows.select(*RUN, F.lit("rows").alias("axis"), F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "n")
    return sets.withColumn("n", F.lit(None).cast("bigint")).unionByName(rows)


# --- contents -----------------------------------------------------------------------------

CONTENT = ("id", "raw_import_id", "location_id", "time_id", PAYLOAD, "source_name")


def fact_digests(fact: DataFrame) -> DataFrame:
    """For each run how many facts it has, and sum and parity of the hashes of what they say. Order and
    files do not matter, nor when a fact was written."""
    hashed = fact.select(*RUN, F.xxhash64(*CONTENT).alias("_h"))
    return hashed.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("total"),
        F.bit_xor("_h").alias("parity"),
    )


# --- pages --------------------------------------------------------------------------------


def fact_pages(fact: DataFrame) -> DataFrame:
    """Facts as they are, to be laid out by id."""
    return fact.select("id", "raw_import_id", "location_id", "time_id", PAYLOAD, "inserted_at", *RUN)


RUN_DERIVED = {
    t.name: t
    for t in (
        RunTable("fact_values", _schema("id string, location_id string, time_id string, payload variant" + _RUN_COLUMNS), fact_values, by_row=True),
        RunTable("payload_terms", _schema("name string, kind string, value string, id string" + _RUN_COLUMNS), payload_terms, ("name", "kind", "value")),
        RunTable(
            "metric_partials",
            _schema("axis string, key string, metric_name string, n_rows bigint, n bigint, total double, least double, most double" + _RUN_COLUMNS),
            metric_partials,
            ("axis", "metric_name"),
        ),
        RunTable("key_bitmaps", _schema("axis string, bucket bigint, bits binary, n bigint" + _RUN_COLUMNS), key_bitmaps, ("axis",), counted_keys),
        RunTable("fact_pages", FACT_SCHEMA, fact_pages, cluster="id"),
        RunTable("fact_digests", _schema("n bigint, total string, parity bigint" + _RUN_COLUMNS), fact_digests),
    )
}
