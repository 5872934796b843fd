"""Every registered query: a DataFrame over the given tables and its SQL."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import feeds as Q
from queries import sqltext as S
from queries.sqltext import with_steps
from terrafact import FieldDef, OnFailure, RuleDef, SourceConfig
from terrafact.functions import coerce as C
from terrafact.functions import keys as K
from terrafact.functions import places as P
from terrafact.functions.rules import field_kinds
from terrafact.operators import analytics as A
from terrafact.operators import dimensions as D
from terrafact.operators import facts as FA
from terrafact.operators import keep as KP
from terrafact.operators import payload as PY
from terrafact.operators import reads as RD
from terrafact.operators import registry as RG
from terrafact.operators import runtables as RT
from terrafact.operators import transform as TR
from terrafact.plans import export as EX
from terrafact.plans import integrity as IT
from terrafact.plans import jobs as J
from terrafact.plans.fact_load import FactLoad, fact_load
from terrafact.sources import feeds as FD
from terrafact.sources.feeds import FILE, POSITION, ROW, RUN
from terrafact.sources.warehouse import Warehouse, shared_folder
from terrafact.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_steps(sql)
        return f

    return register


# Shared pieces


def changed(source: SourceConfig, **values) -> SourceConfig:
    return SourceConfig(**{**J._arguments(source), **values})


def clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    return FD.clean(Q.orders_feed(spark, sf))


def orders_load(spark: SparkSession, sf: str, source: SourceConfig = Q.ORDERS, staged: bool = False) -> FactLoad:
    """The order feed as a load; staged where more than one of its frames is used."""
    folder = staging(spark) if staged else None
    return fact_load(clean_orders(spark, sf), source, P.country_of_path(F.col(FILE)), folder=folder)


def staging(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/linked-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table, as dimensions are in a warehouse."""
    folder = staging(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


ORDER_FIELDS = ("order_key", "priority", "region_name", "status", "total_price")


def orders_tall(spark: SparkSession, sf: str) -> DataFrame:
    return PY.to_observations(orders_load(spark, sf).facts, ORDER_FIELDS)


def micros(c: str):
    return F.unix_micros(c).alias(c)


def key_of(text: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, text))


def new_warehouse(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, f"{shared_folder(spark).rstrip('/')}/wh-{uuid.uuid4()}")


def flat(fact: DataFrame, *columns: str) -> DataFrame:
    """Payload fields of order facts as columns, to compare by value."""
    p = PY.parsed(["order_key", "priority", "region_name", "status", "total_price"])
    return fact.withColumn("p", p).select(
        *columns,
        F.col("p.order_key").cast("bigint").alias("order_key"),
        F.col("p.priority").alias("priority"),
        F.col("p.region_name").alias("region_name"),
        F.col("p.status").alias("status"),
        F.col("p.total_price").cast("double").alias("total_price"),
    )


PAYLOAD_SQL = "order_key, priority, region_name, status, total_price"


def write_csv(df: DataFrame, folder: str) -> list[str]:
    """Write a feed as CSV files with headers; returns the files."""
    columns = FD.feed_columns(df)
    df.select(*columns).write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    rows = df.sparkSession.read.format("binaryFile").load(f"{folder}/*.csv").select("path")
    return sorted(r[0] for r in rows.collect())


def one_run(feed: DataFrame, run: str) -> DataFrame:
    return feed.withColumns({RUN: F.lit(run), POSITION: F.lit(0)})


# Text to values


@query(f"""
SELECT k AS order_key, {S.integer('"order"', "TINYINT")} AS as_i8,
       {S.integer('"order"', "SMALLINT")} AS as_i16, {S.integer("total_int", "INTEGER")} AS as_i32,
       {S.integer("wide", "BIGINT")} AS as_i64
FROM (SELECT *, replace(total, '.', '') AS total_int, total || '0000000000000' AS w,
             replace(total || '0000000000000', '.', '') AS wide FROM orders_clean)
""")
def signed_ints(spark, sf):
    """Signed integers of every width, overflow and non-numbers null."""
    df = clean_orders(spark, sf)
    digits = F.replace(F.col("total"), F.lit("."), F.lit(""))
    wide = F.replace(
        F.concat(F.col("total"), F.lit("0000000000000")), F.lit("."), F.lit("")
    )
    return df.select(
        F.col(ROW).alias("order_key"),
        C.signed_int(F.col("order"), "i8").alias("as_i8"),
        C.signed_int(F.col("order"), "i16").alias("as_i16"),
        C.signed_int(digits, "i32").alias("as_i32"),
        C.signed_int(wide, "i64").alias("as_i64"),
    )


@query(f"""
SELECT k AS order_key, CAST({S.integer('"order"', "UTINYINT")} AS SMALLINT) AS as_u8,
       CAST({S.integer('"order"', "USMALLINT")} AS INTEGER) AS as_u16,
       CAST({S.integer("digits", "UINTEGER")} AS BIGINT) AS as_u32,
       CAST({S.integer("wide", "UBIGINT")} AS VARCHAR) AS as_u64
FROM (SELECT *, replace(total, '.', '') || '00' AS digits,
             replace(total || '0000000000000', '.', '') AS wide FROM orders_clean)
""")
def unsigned_ints(spark, sf):
    """Unsigned integers of every width in the next wider signed type."""
    digits = F.replace(F.col("total"), F.lit("."), F.lit(""))
    return clean_orders(spark, sf).select(
        F.col(ROW).alias("order_key"),
        C.unsigned_int(F.col("order"), "u8").alias("as_u8"),
        C.unsigned_int(F.col("order"), "u16").alias("as_u16"),
        C.unsigned_int(F.concat(digits, F.lit("00")), "u32").alias("as_u32"),
        C.unsigned_int(
            F.replace(F.concat(F.col("total"), F.lit("0000000000000")), F.lit("."), F.lit("")), "u64"
        )
        .cast("string")
        .alias("as_u64"),
    )


@query(f"""
SELECT k AS order_key, {S.number("total")} AS as_f64,
       CAST({S.number("total", "FLOAT")} AS DOUBLE) AS as_f32,
       {S.number("suffixed")} AS from_suffixed
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN total || 'd' ELSE total || 'e-2' END AS suffixed
      FROM orders_clean)
""")
def floats(spark, sf):
    """Floats of both widths; suffixes and words that are not numbers fail."""
    total, k = F.col("total"), F.col(ROW)
    suffixed = F.when(k % 3 == 0, F.concat(total, F.lit("d"))).otherwise(
        F.concat(total, F.lit("e-2"))
    )
    return clean_orders(spark, sf).select(
        k.alias("order_key"),
        C.floating(total, "f64").alias("as_f64"),
        C.floating(total, "f32").cast("double").alias("as_f32"),
        C.floating(suffixed, "f64").alias("from_suffixed"),
    )


def events_values(spark, sf, *columns: str) -> DataFrame:
    rows = TR.apply_transforms(FD.clean(Q.events_feed(spark, sf)), Q.EVENTS)
    return rows.select("event_id", *columns)


@query("SELECT event_id, flag FROM events_rows")
def booleans(spark, sf):
    return events_values(spark, sf, "flag")


@query("SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events_rows")
def json_values(spark, sf):
    """Whole JSON values pass, broken ones and ones with text behind them fail."""
    inner = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return events_values(spark, sf, "props", inner)


@query("""
SELECT k AS order_key,
       CAST(try_strptime(year || '-' || month || '-' || day, '%Y-%m-%d') AS DATE) AS iso8601,
       CAST(try_strptime(month || '/' || (CAST(day AS INTEGER) + 3) || '/' || year, '%m/%d/%Y')
            AS DATE) AS month_day_year,
       CAST(try_strptime(day || '/' || month || '/' || year, '%d/%m/%Y') AS DATE)
           AS day_month_year,
       CAST(try_strptime(strftime(d, '%Y%m%d'), '%Y%m%d') AS DATE) AS year_month_day,
       CAST(d AS DATE) AS long_us
FROM orders_clean JOIN (SELECT o_orderkey, o_orderdate AS d FROM orders) ON k = o_orderkey
""")
def dates(spark, sf):
    """Dates in all formats; days that a month does not have are null."""
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    late = (d.cast("int") + 3).cast("string")
    day = F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))
    return clean_orders(spark, sf).select(
        F.col(ROW).alias("order_key"),
        C.date(F.concat_ws("-", y, m, d)).alias("iso8601"),
        C.date(F.concat_ws("/", m, late, y), "month_day_year").alias("month_day_year"),
        C.date(F.concat_ws("/", d, m, y), "day_month_year").alias("day_month_year"),
        C.date(F.date_format(day, "yyyyMMdd"), "year_month_day").alias("year_month_day"),
        C.date(F.date_format(day, "MMMM d, yyyy"), "long_us").alias("long_us"),
    )


@query("SELECT event_id, at_rfc3339 FROM events_rows")
def timestamps_rfc3339(spark, sf):
    return events_values(spark, sf, micros("at_rfc3339"))


@query("SELECT event_id, at_rfc2822 FROM events_rows")
def timestamps_rfc2822(spark, sf):
    return events_values(spark, sf, micros("at_rfc2822"))


@query("SELECT event_id, at_seconds, at_millis FROM events_rows")
def timestamps_unix(spark, sf):
    return events_values(spark, sf, micros("at_seconds"), micros("at_millis"))


@query("SELECT event_id, at_us FROM events_rows")
def timestamps_us(spark, sf):
    return events_values(spark, sf, micros("at_us"))


@query("SELECT k AS order_key, state, state_code FROM orders_rows")
def state_name_to_code(spark, sf):
    return clean_orders(spark, sf).select(
        F.col(ROW).alias("order_key"), "state", P.state_code(F.col("state")).alias("state_code")
    )


@query("""
SELECT event_id, flag AS as_rule, flag AS as_rule_twice, NULL :: BOOLEAN AS as_rule_then_type,
       CASE WHEN flag IS NULL THEN 1 ELSE 2 END AS level
FROM events_rows
""")
def str_to_bool(spark, sf):
    """The rule reads words and passes booleans; a coercion after it always fails."""
    rule = RuleDef("str_to_bool", OnFailure.SKIP_ROW)
    source = SourceConfig(
        "flags",
        fields=(
            FieldDef("event", "event_id", "bigint"),
            FieldDef("flag", "as_rule", rules=(rule,)),
            FieldDef("flag", "as_rule_twice", rules=(rule, rule)),
            FieldDef(
                "flag",
                "as_rule_then_type",
                "boolean",
                rules=(RuleDef("str_to_bool"),),
                on_failure=OnFailure.IGNORE,
            ),
            FieldDef(
                "flag", "late", "boolean", on_failure=OnFailure.SKIP_DATASET, rules=(RuleDef("str_to_bool"),)
            ),
        ),
    ).validate()
    rows = TR.apply_transforms(FD.clean(Q.events_feed(spark, sf)), source)
    strict = F.when(F.col("as_rule").isNull(), 1).otherwise(F.col(TR.LEVEL)).alias("level")
    return rows.select("event_id", "as_rule", "as_rule_twice", "as_rule_then_type", strict)


STRICT_ORDERS = SourceConfig(
    "strict",
    fields=(
        FieldDef("Order", "order_key", "bigint"),
        FieldDef(
            "State",
            "state_code",
            rules=(RuleDef("state_name_to_code", OnFailure.SKIP_ROW),),
        ),
        FieldDef("Total", "total_price", "float8", on_failure=OnFailure.SKIP_DATASET),
        FieldDef("Quarter", "quarter", "i8"),
        FieldDef("Day", "day", "float8", rules=(RuleDef("state_name_to_code"),)),
    ),
)
BAD_TOTAL = f"(total IS NOT NULL AND {S.number('total')} IS NULL)"


@query(f"""
SELECT order_key, state_code, total_price, quarter, NULL :: DOUBLE AS day,
       CASE WHEN {BAD_TOTAL} THEN 2 ELSE level END AS level
FROM orders_rows
""")
def failure_policies(spark, sf):
    """Chains with every policy; a row counts as its strictest failure."""
    rows = TR.apply_transforms(clean_orders(spark, sf), STRICT_ORDERS)
    return rows.select(
        "order_key",
        "state_code",
        "total_price",
        F.col("quarter").cast("smallint").alias("quarter"),
        "day",
        F.col(TR.LEVEL).alias("level"),
    )


@query(f"""
SELECT order_key, region_name, total_price FROM orders_rows WHERE level = 0 AND NOT {BAD_TOTAL}
""")
def kept_rows(spark, sf):
    """Rows that neither rule nor type asked to skip."""
    source = changed(
        Q.ORDERS,
        fields=tuple(
            FieldDef(f.column, f.canonical, f.type, on_failure=OnFailure.SKIP_ROW)
            if f.canonical == "total_price"
            else f
            for f in Q.ORDERS.fields
        ),
    )
    rows = TR.kept_rows(TR.apply_transforms(clean_orders(spark, sf), source))
    return rows.select("order_key", "region_name", "total_price")


@query(f"""
SELECT order_key AS row, 'state_code' AS field, state AS input, 'skip_row' AS policy
FROM orders_rows WHERE level = 1
UNION ALL
SELECT order_key, 'total_price', total, 'skip_dataset' FROM orders_rows WHERE {BAD_TOTAL}
""")
def rejects(spark, sf):
    return TR.rejects(clean_orders(spark, sf), STRICT_ORDERS).select(
        F.col(ROW).alias("row"), "field", "input", "policy"
    )


@query("".join(f"""
SELECT '{t}' AS field, count(*) AS rows,
       count(*) FILTER (k % 11 = 0 AND k % 13 <> 0) AS blank,
       count(*) FILTER (k % 13 = 0) AS failed, count(r.{t}) AS kept
FROM events_feed f JOIN events_rows r ON f.k = r.event_id
UNION ALL""" for t in ("at_rfc3339", "at_rfc2822", "at_seconds", "at_millis", "at_us")) + """
SELECT 'event_id', count(*), 0, 0, count(*) FROM events_feed
UNION ALL
SELECT 'user_id', count(*), count(*) FILTER (f."user" IS NULL),
       count(*) FILTER (f."user" IS NOT NULL AND r.user_id IS NULL), count(r.user_id)
FROM events_feed f JOIN events_rows r ON f.k = r.event_id
UNION ALL
SELECT 'value', count(*), count(*) FILTER (k % 11 = 0),
       count(*) FILTER (k % 11 <> 0 AND k % 13 = 0), count(r.value)
FROM events_feed f JOIN events_rows r ON f.k = r.event_id
UNION ALL
SELECT 'props', count(*), count(*) FILTER (f.props IS NULL),
       count(*) FILTER (f.props IS NOT NULL AND r.props IS NULL), count(r.props)
FROM events_feed f JOIN events_rows r ON f.k = r.event_id
UNION ALL
SELECT 'flag', count(*), 0, count(*) FILTER (r.flag IS NULL), count(r.flag)
FROM events_feed f JOIN events_rows r ON f.k = r.event_id
UNION ALL
SELECT 'kind', count(*), 0, 0, count(*) FROM events_feed
""")
def type_profile(spark, sf):
    """What became of the values of all fields, in one pass."""
    return TR.type_profile(FD.clean(Q.events_feed(spark, sf)), Q.EVENTS)


# Keys, places, calendar


@query(f"""
SELECT k AS order_key, {S.uuid5("'county=' || county || '|order=' || \"order\" || '|total=' || coalesce(total, '')")} AS id
FROM orders_clean
""")
def uuid5_key(spark, sf):
    text = K.joined_key([("total", F.col("total")), ("order", F.col("order")), ("county", F.col("county"))])
    return clean_orders(spark, sf).select(F.col(ROW).alias("order_key"), K.uuid5(text).alias("id"))


@query(f"""
SELECT order_key, {S.uuid5("'single=' || " + S.float_bits("single", 127, 23) + " || '|total_price=' || " + S.float_bits("total_price", 1023, 52))} AS id
FROM (SELECT *, CAST(CAST(total_price AS FLOAT) AS DOUBLE) AS single FROM orders_rows)
""")
def float_keys(spark, sf):
    """Keys over floats of both widths, spelt by their bits."""
    rows = TR.apply_transforms(clean_orders(spark, sf), Q.ORDERS)
    kinds = {"total_price": "f64", "single": "f32"}
    rows = rows.withColumn("single", F.col("total_price").cast("float"))
    return rows.select("order_key", D.row_key(("total_price", "single"), kinds).alias("id"))


@query("SELECT count(*) AS n, count(*) AS distinct_ids FROM orders")
def random_keys(spark, sf):
    """Rows without a key get ids of their own."""
    rows = clean_orders(spark, sf).select(D.row_key((), {}).alias("id"))
    per_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_ids"))


@query("SELECT k AS order_key, country FROM orders_rows")
def country_of_path(spark, sf):
    return Q.orders_feed(spark, sf).select(
        F.col(ROW).alias("order_key"), P.country_of_path(F.col(FILE)).alias("country")
    )


@query("SELECT id, year, quarter, month, day, date_floor FROM calendar_rows")
def calendar_load(spark, sf):
    """A calendar feed as time rows: impossible parts null, first day computed."""
    rows = TR.kept_rows(TR.apply_transforms(FD.clean(Q.calendar_feed(spark, sf)), Q.CALENDAR))
    return D.time_load_rows(rows, field_kinds(Q.CALENDAR.by_canonical), Q.CALENDAR.unique_key)


@query(f"""
SELECT o_orderkey AS order_key, {S.floor_of("year(o_orderdate)", S.within("q", 1, 4), S.within("m", 1, 12), S.within("d", 1, 31))} AS date_floor
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 END AS q,
             CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 14 END AS m,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 33 END AS d FROM orders)
""")
def date_floor(spark, sf):
    k = F.col("o_orderkey")
    part = {
        "q": F.when(k % 3 != 0, k % 6),
        "m": F.when(k % 2 != 0, k % 14),
        "d": F.when(k % 5 != 0, k % 33),
    }
    return Q.table(spark, sf, "orders").select(
        k.alias("order_key"),
        P.date_floor(
            F.year("o_orderdate"),
            P.within(part["q"], 1, 4),
            P.within(part["m"], 1, 12),
            P.within(part["d"], 1, 31),
        ).alias("date_floor"),
    )


FIPS_SQL = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in P.FIPS_STATES.items())


@query(f"""
SELECT c_custkey, CASE lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') {FIPS_SQL} END AS state
FROM customer
""")
def state_of_fips(spark, sf):
    number = F.col("c_custkey") % 60
    return Q.table(spark, sf, "customer").select("c_custkey", P.state_of_fips(number).alias("state"))


def places(spark, sf, second: bool = False) -> DataFrame:
    rows = TR.kept_rows(TR.apply_transforms(FD.clean(Q.places_feed(spark, sf, second)), Q.PLACES))
    return D.location_load_rows(rows, field_kinds(Q.PLACES.by_canonical), Q.PLACES.unique_key)


@query("""
SELECT id, country, state_code, state_name, fips_code, county, population, density,
       CAST(json_extract_string(county_weights, '$.w') AS BIGINT) AS weight, military,
       latitude, longitude, NULL :: VARCHAR AS zip_code
FROM places_rows
""")
def dimension_accessors(spark, sf):
    """Fields of other types as the location's columns: numbers and flags are
    read from text, a typed zip code is part of the key but not of the row."""
    weight = F.get_json_object("county_weights", "$.w").cast("bigint").alias("weight")
    return places(spark, sf).select(
        "id", "country", "state_code", "state_name", "fips_code", "county", "population",
        "density", weight, "military", "latitude", "longitude", "zip_code",
    )


MERGED_SQL = """
SELECT a.id, a.county, {population} AS population, {density} AS density
FROM places_rows a
"""


@query(
    MERGED_SQL.format(
        population="CASE WHEN k % 2 = 1 THEN population + 1000 ELSE population END",
        density="CASE WHEN k % 2 = 1 THEN NULL ELSE density END",
    )
)
def upsert_location(spark, sf):
    """A second load replaces whole rows, what it does not know included."""
    merged = D.upsert_location(places(spark, sf, second=True), places(spark, sf))
    return merged.select("id", "county", "population", "density")


@query(
    MERGED_SQL.format(
        population="CASE WHEN k % 2 = 1 THEN population + 1000 ELSE population END",
        density="density",
    )
)
def upsert_location_coalesce(spark, sf):
    """The safe merge fills what the second load does not know."""
    merged = D.upsert_location(places(spark, sf, second=True), places(spark, sf), "coalesce")
    return merged.select("id", "county", "population", "density")


@query("""
SELECT id, year, quarter, month, day, date_floor FROM calendar_rows
UNION
SELECT id, year, quarter, month, day, date_floor FROM orders_times
""")
def upsert_time(spark, sf):
    """Periods of a fact load merged into those of a calendar load."""
    return D.upsert_time(orders_load(spark, sf).times, calendar_load(spark, sf))


# Scans and row shape


@query("""
SELECT k AS order_key, region, state, county || ', "' || county || E'"\\nline' AS county, fips, total,
       priority
FROM orders_clean
""")
def csv_scan(spark, sf):
    """The feed written as CSV, quotes, commas and line breaks included, and read back."""
    county = F.concat(
        F.col("County"), F.lit(', "'), F.col("County"), F.lit('"\nline')
    )
    feed = Q.orders_feed(spark, sf).withColumn("County", county)
    files = write_csv(feed, f"{shared_folder(spark)}/csv-{uuid.uuid4()}")
    return FD.clean(FD.read_csv(spark, files)).select(
        F.col("order").cast("bigint").alias("order_key"),
        "region", "state", "county", "fips", "total", "priority",
    )


@query("SELECT * EXCLUDE (file, k) FROM orders_clean")
def clean(spark, sf):
    df = clean_orders(spark, sf)
    return df.select(*FD.feed_columns(df))


@query("SELECT * EXCLUDE (file, k, region, total) FROM orders_clean")
def drop_excluded(spark, sf):
    df = FD.drop_excluded(clean_orders(spark, sf), ["TOTAL", "Region"])
    return df.select(*FD.feed_columns(df))


@query("""
SELECT state AS state_code, fips AS fips_code, total AS total_price, NULL :: VARCHAR AS absent,
       k AS order_key FROM orders_clean
""")
def project_fields(spark, sf):
    """Canonical names; a column that the feed lacks is null."""
    source = SourceConfig(
        "few",
        fields=(
            FieldDef("STATE", "state_code"),
            FieldDef("fips", "fips_code"),
            FieldDef("Total", "total_price"),
            FieldDef("not there", "absent"),
        ),
    )
    df = TR.project_fields(clean_orders(spark, sf), source)
    return df.withColumnRenamed(ROW, "order_key").drop(FILE)


@query("""
SELECT 'ignore' AS stale, count(*) AS rows FROM orders_rows WHERE level = 0
UNION ALL SELECT 'reject', 0
UNION ALL SELECT 'none', count(*) FROM orders_rows WHERE level = 0
""")
def check_complete(spark, sf):
    """A field that is registered but not defined any more empties the load."""
    rows = TR.kept_rows(TR.apply_transforms(clean_orders(spark, sf), Q.ORDERS))
    old = Q.ORDERS.schema | {"gone": "text"}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cases = {
            "reject": TR.check_complete(rows, old, set()),
            "ignore": TR.check_complete(rows, old, set(), "ignore"),
            "none": TR.check_complete(rows, Q.ORDERS.schema, set()),
        }
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stale"), "rows")
        for name, df in cases.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""
SELECT k AS event_id, event, at_us, "user", kind, nullif(trim(value, E' \\t'), '') AS value,
       nullif(trim(props), '') AS props, flag, CASE WHEN at_us = '' THEN 1 ELSE 0 END AS blanks
FROM (SELECT * REPLACE (nullif(at_us, '') AS at_us), CASE WHEN at_us = '' THEN 1 END AS b FROM events_feed)
""".replace("CASE WHEN at_us = '' THEN 1 ELSE 0 END AS blanks", "coalesce(b, 0) AS blanks"))
def raw_rows(spark, sf):
    """Audit rows: the whole cleaned row as JSON, blanks as explicit nulls, read back."""
    raw = FA.raw_rows(FD.clean(Q.events_feed(spark, sf)))
    names = ["event", "at_us", "user", "kind", "value", "props", "flag"]
    values = PY.parsed(names, "raw_data")
    blank = F.col("raw_data").contains('"at_us":null').cast("int")
    return raw.select(F.col(ROW).alias("event_id"), values.alias("r"), blank.alias("blanks")).select(
        "event_id", "r.*", "blanks"
    )


@query(f"SELECT id, {PAYLOAD_SQL} FROM orders_linked")
def payload(spark, sf):
    """The payload as JSON, dimension fields left out, read back as columns."""
    return flat(orders_load(spark, sf).facts, "id")


@query("""
SELECT event_id, value, props, flag, at_rfc3339 FROM events_rows
""")
def payload_types(spark, sf):
    """Numbers, nested JSON, flags and instants survive the payload."""
    facts = fact_load(FD.clean(Q.events_feed(spark, sf)), Q.EVENTS).facts
    p = PY.parsed(["event_id", "value", "props", "flag", "at_rfc3339"])
    # The payload holds JSON without blanks between its tokens.
    props = F.replace(F.col("p.props"), F.lit(":"), F.lit(": "))
    return facts.select(p.alias("p")).select(
        F.col("p.event_id").cast("bigint").alias("event_id"),
        F.col("p.value").cast("double").alias("value"),
        props.alias("props"),
        F.col("p.flag").cast("boolean").alias("flag"),
        F.unix_micros(F.col("p.at_rfc3339").cast("timestamp")).alias("at_rfc3339"),
    )


@query("SELECT k AS order_key, region, county, state_text, total FROM "
       "(SELECT k, region, county, state AS state_text, total, "
       f"{S.state_code('state')} AS code, state FROM orders_clean) WHERE code IS NOT NULL OR state IS NULL")
def keep_unmapped(spark, sf):
    """Feed columns without a definition carried along in the payload."""
    source = changed(
        Q.ORDERS,
        unmapped="keep",
        fields=tuple(f for f in Q.ORDERS.fields if f.canonical in ("order_key", "state_code")),
    )
    facts = fact_load(
        clean_orders(spark, sf).withColumn("state_text", F.col("state")), source
    ).facts
    p = PY.parsed(["order_key", "region", "county", "state_text", "total"])
    return facts.select(p.alias("p")).select(
        F.col("p.order_key").cast("bigint").alias("order_key"),
        "p.region", "p.county", "p.state_text", "p.total",
    )


# Links, look-ups, star


@query("SELECT order_key, location_id FROM orders_linked")
def location_key(spark, sf):
    return orders_load(spark, sf).canonical.select("order_key", "location_id")


@query("SELECT id, county, country, fips_code, state_code FROM orders_locations")
def location_rows(spark, sf):
    """Places of a fact feed: the first row of each wins."""
    return orders_load(spark, sf).locations.select("id", "county", "country", "fips_code", "state_code")


@query("SELECT order_key, time_id FROM orders_linked")
def time_key(spark, sf):
    return orders_load(spark, sf).canonical.select("order_key", "time_id")


@query("SELECT id, year, quarter, month, day, date_floor FROM orders_times")
def time_rows(spark, sf):
    return orders_load(spark, sf).times


def enriched_location(spark, sf) -> DataFrame:
    """Places of the order feed, state names and zones known for some of them."""
    known = places(spark, sf).select("fips_code", F.col("state_name").alias("known_name"))
    number = F.col("fips_code").cast("int")
    base = orders_load(spark, sf).locations
    return (
        base.join(known, "fips_code", "left")
        .withColumn("state_name", F.when(number % 3 != 0, F.col("known_name")))
        .withColumn("timezone", F.when(number % 5 != 0, F.concat(F.lit("Zone/"), "fips_code")))
        .drop("known_name")
    )


@query(f"""
SELECT id, order_key, ({S.STATES})[CAST(fips_code AS INTEGER) + 1] AS place_name,
       'Zone/' || fips_code AS place_zone
FROM orders_linked WHERE CAST(fips_code AS INTEGER) % 3 <> 0 AND CAST(fips_code AS INTEGER) % 5 <> 0
""")
def derived_lookup(spark, sf):
    """Payload fields looked up in the location; rows without a value are dropped."""
    load = orders_load(spark, sf)
    location = enriched_location(spark, sf)
    rows = FA.resolve_derived(load.canonical, Q.ENRICHED.derived, location, load.times)
    kinds = field_kinds(Q.ENRICHED.by_canonical)
    rows = FA.collect_payload(rows, kinds, Q.ENRICHED.schema, Q.ENRICHED.derived_names)
    p = PY.parsed(["order_key", "place_name", "place_zone"])
    return rows.select("id", p.alias("p")).select(
        "id",
        F.col("p.order_key").cast("bigint").alias("order_key"),
        "p.place_name",
        "p.place_zone",
    )


@query(f"""
SELECT n.id, {PAYLOAD_SQL}, l.state_code, l.county, l.fips_code, t.year, t.quarter, t.month
FROM orders_linked n LEFT JOIN orders_locations l ON l.id = n.location_id
LEFT JOIN orders_times t ON t.id = n.time_id
""")
def star_view(spark, sf):
    load = orders_load(spark, sf, staged=True)
    star = A.star_view(load.facts, load.locations, load.times)
    return flat(star, "id", "state_code", "county", "fips_code", "year", "quarter", "month")


# Sinks


@query("""
SELECT id, order_key, line_number, quantity, price, ship_date
FROM lines_rows WHERE rn = 1
""")
def fact_dedupe(spark, sf):
    """Line items with repeated keys: the first row of each key is the fact."""
    return lines_facts(spark, sf)


def lines_facts(spark, sf, existing: DataFrame | None = None) -> DataFrame:
    load = fact_load(FD.clean(Q.lines_feed(spark, sf)), Q.LINES)
    if existing is None:
        facts = KP.first_per_key(load.facts, "id", ROW)
    else:
        facts = FA.append_facts(load.facts, existing)
    p = PY.parsed(["order_key", "line_number", "quantity", "price", "ship_date"])
    return facts.select("id", p.alias("p")).select(
        "id",
        F.col("p.order_key").cast("bigint").alias("order_key"),
        F.col("p.line_number").cast("int").alias("line_number"),
        F.col("p.quantity").cast("double").alias("quantity"),
        F.col("p.price").cast("double").alias("price"),
        F.col("p.ship_date").cast("date").alias("ship_date"),
    )


@query("""
SELECT id, order_key, line_number, quantity, price, ship_date FROM lines_rows l
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM lines_rows e WHERE e.id = l.id AND e.l_returnflag = 'A')
""")
def append_facts(spark, sf):
    """Insert-ignore: rows whose key an earlier batch loaded are left out."""
    feed = FD.clean(Q.lines_feed(spark, sf)).filter(F.col("l_returnflag") == "A")
    return lines_facts(spark, sf, fact_load(feed, Q.LINES).facts)


@query("""
SELECT id, acct_balance, supplier_key FROM suppliers_keyed WHERE rn = 1
""")
def key_collisions(spark, sf):
    """Facts keyed by place and time alone: many measurements become one."""
    facts = KP.first_per_key(fact_load(FD.clean(Q.suppliers_feed(spark, sf)), Q.SUPPLIERS).facts, "id", ROW)
    p = PY.parsed(["acct_balance", "supplier_key"])
    return facts.select("id", p.alias("p")).select(
        "id",
        F.col("p.acct_balance").cast("double").alias("acct_balance"),
        F.col("p.supplier_key").cast("bigint").alias("supplier_key"),
    )


# Registries


def registry_batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Fields declared by event kind and user, in two batches."""
    events = Q.table(spark, sf, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))

    def batch(rows: DataFrame, kind: str, day: str) -> DataFrame:
        return (
            rows.select(F.col("event_type").alias("source_name"), name.alias("field_name"))
            .distinct()
            .select(
                "*",
                F.lit(kind).alias("field_type"),
                F.lit(None).cast("string").alias("description"),
                F.lit(day).cast("timestamp").alias("created_at"),
            )
        )

    old = batch(events.filter(F.col("value") < 10), "text", "2024-01-01")
    new = batch(events.filter(F.col("value") >= 5), "float8", "2024-06-01")
    return new, old


REGISTRY_SQL = """
SELECT source_name, field_name, CASE WHEN n > 0 THEN 'float8' ELSE 'text' END AS field_type,
       CASE WHEN o > 0 THEN 1704067200 ELSE 1717200000 END AS created_at
FROM (SELECT event_type AS source_name, 'user_' || user_id AS field_name,
             count(*) FILTER (value < 10) AS o, count(*) FILTER (value >= 5) AS n
      FROM events GROUP BY event_type, user_id)
"""


@query(REGISTRY_SQL)
def register_schema(spark, sf):
    """Declaring fields again changes their type and keeps their first date."""
    merged = RG.register_schema(*registry_batches(spark, sf))
    created = F.unix_seconds("created_at").alias("created_at")
    return merged.select("source_name", "field_name", "field_type", created)


@query(f"SELECT field_name, field_type FROM ({REGISTRY_SQL}) WHERE source_name = 'click'")
def load_schema(spark, sf):
    return RG.schema_of(RG.register_schema(*registry_batches(spark, sf)), "click")


@query(f"SELECT source_name, count(*) AS fields FROM ({REGISTRY_SQL}) GROUP BY source_name")
def fields_per_source(spark, sf):
    return A.fields_per_source(RG.register_schema(*registry_batches(spark, sf)))


def named_suppliers(spark, sf) -> DataFrame:
    return Q.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("description"), "s_acctbal"
    )


@query("SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS description FROM supplier WHERE s_acctbal >= 0")
def register_source(spark, sf):
    """Sources whose names are free; known names are conflicts."""
    names = named_suppliers(spark, sf)
    return RG.new_sources(names.drop("s_acctbal"), names.filter("s_acctbal < 0"))


@query("SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS description FROM supplier")
def list_sources(spark, sf):
    return RD.list_sources(named_suppliers(spark, sf).drop("s_acctbal"))


@query("SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS description FROM supplier WHERE s_suppkey = 7")
def find_source(spark, sf):
    """A source by name; another name is not found."""
    sources = named_suppliers(spark, sf).drop("s_acctbal")
    name = sources.filter("description = '7'").first()["name"]
    try:
        RD.find_source(sources, f"{name} ")
    except RD.NotFound:
        return spark.createDataFrame([RD.find_source(sources, name)], sources.schema)


@query("SELECT s_name AS source_name, 'feeds/' || n_name || '.csv' AS file_path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 2000")
def pending_dim_files(spark, sf):
    """(source, file) pairs without a successful dimension load in the log."""
    supplier, nation = Q.table(spark, sf, "supplier"), Q.table(spark, sf, "nation")
    pairs = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_name").alias("source_name"),
        F.concat(F.lit("feeds/"), "n_name", F.lit(".csv")).alias("file_path"),
        "s_acctbal",
    )
    return RG.pending_dim_files(pairs.drop("s_acctbal"), pairs.filter("s_acctbal >= 2000"))


@query("SELECT DISTINCT 'feeds/' || o_custkey || '.csv' AS source_file FROM orders "
       "WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_files(spark, sf):
    """Listed files that no raw row came from."""
    rows = Q.table(spark, sf, "orders").select(
        F.concat(F.lit("feeds/"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("source_file"),
        "o_orderstatus",
    )
    listed = rows.select("source_file").distinct()
    return RG.pending_files(listed, rows.filter("o_orderstatus = 'F'"))


# Reads

PLACE_ID = key_of("city=|country=US|fips_code=00002|state_code=AZ|zip_code=")
TIME_ID = key_of("day=|month=|quarter=5|year=1996")


@query(f"SELECT id, location_id, time_id, source_name FROM (SELECT *, 'orders' AS source_name FROM orders_linked) "
       f"WHERE location_id = '{PLACE_ID}' ORDER BY id LIMIT 100 OFFSET 10")
def query_observations(spark, sf):
    """A page of the facts of one place."""
    facts = orders_load(spark, sf).facts.select("id", "location_id", "time_id", "source_name")
    return RD.query_observations(facts, "orders", location_id=PLACE_ID, offset=10)


@query("SELECT id FROM orders_linked WHERE id > '80000000-0000-5000-8000-000000000000' ORDER BY id LIMIT 100")
def next_page(spark, sf):
    """The page behind an id."""
    facts = orders_load(spark, sf).facts.select("id")
    return RD.observations_after(facts, "80000000-0000-5000-8000-000000000000")


@query("SELECT id FROM orders_linked WHERE id < '80000000-0000-5000-8000-000000000000' ORDER BY id DESC LIMIT 100")
def previous_page(spark, sf):
    """The page in front of an id."""
    facts = orders_load(spark, sf).facts.select("id")
    return RD.observations_before(facts, "80000000-0000-5000-8000-000000000000")


@query(f"SELECT id, county, country, fips_code, state_code FROM orders_locations WHERE id = '{PLACE_ID}'")
def find_location(spark, sf):
    rows = RD.find_by_id(orders_load(spark, sf).locations, PLACE_ID)
    return rows.select("id", "county", "country", "fips_code", "state_code")


@query(f"SELECT id, year, quarter, month, day, date_floor FROM calendar_rows WHERE id = '{TIME_ID}'")
def find_time(spark, sf):
    return RD.find_by_id(calendar_load(spark, sf), TIME_ID)


@query("""
SELECT id, county, fips_code FROM orders_locations
ORDER BY county ASC NULLS LAST, id LIMIT 200 OFFSET 5
""")
def list_locations(spark, sf):
    """A page of places by county and zip code."""
    rows = RD.list_locations(orders_load(spark, sf).locations, offset=5)
    return rows.select("id", "county", "fips_code")


@query("SELECT id, metric_name, metric_value FROM orders_tall")
def observations(spark, sf):
    """One row per fact and payload field, its number or null; the fields are those found."""
    tall = PY.to_observations(orders_load(spark, sf).facts)
    return tall.select("id", "metric_name", "metric_value")


@query("SELECT id, metric_value FROM orders_tall WHERE metric_name = 'total_price'")
def filter_metric(spark, sf):
    rows = PY.filter_metric(orders_tall(spark, sf), "total_price")
    return rows.select("id", "metric_value")


@query(f"SELECT id, {PAYLOAD_SQL} FROM orders_linked WHERE priority = '1-URGENT' AND status = 'O'")
def payload_contains(spark, sf):
    facts = orders_load(spark, sf).facts
    return flat(PY.payload_contains(facts, {"priority": "1-URGENT", "status": "O"}), "id")


@query("SELECT id, total_price AS price, try_cast(priority AS DOUBLE) AS priority FROM orders_linked")
def payload_field(spark, sf):
    """Payload fields cast; what does not fit is null."""
    facts = orders_load(spark, sf).facts
    facts = PY.payload_field(facts, "total_price", "double", "price")
    return PY.payload_field(facts, "priority", "double").select("id", "price", "priority")


@query("""
SELECT event_id, kind, CASE WHEN flag THEN 'true' WHEN NOT flag THEN 'false' END AS flag,
       at_us IS NOT NULL AS has_time, false AS has_number
FROM events_rows
""")
def extract_context(spark, sf):
    """Payload fields that are not numbers."""
    facts = fact_load(FD.clean(Q.events_feed(spark, sf)), Q.EVENTS).facts
    facts = PY.extract_context(facts, Q.EVENTS.schema)
    p = PY.parsed(["kind", "flag", "at_us", "value", "event_id"], "attributes")
    key = PY.parsed(["event_id"])["event_id"].cast("bigint").alias("event_id")
    return facts.select(key, p.alias("p")).select(
        "event_id",
        "p.kind",
        "p.flag",
        F.col("p.at_us").isNotNull().alias("has_time"),
        F.coalesce("p.value", "p.event_id").isNotNull().alias("has_number"),
    )


@query("""
SELECT event_id, kind, CASE WHEN flag THEN 'true' WHEN NOT flag THEN 'false' END AS flag,
       at_us IS NOT NULL AS has_time, false AS has_number
FROM events_rows
""")
def extract_all_context(spark, sf):
    """The same without naming fields: whatever each payload holds."""
    facts = PY.extract_context(fact_load(FD.clean(Q.events_feed(spark, sf)), Q.EVENTS).facts)
    p = PY.parsed(["kind", "flag", "at_us", "value", "event_id"], "attributes")
    key = PY.parsed(["event_id"])["event_id"].cast("bigint").alias("event_id")
    return facts.select(key, p.alias("p")).select(
        "event_id", "p.kind", "p.flag", F.col("p.at_us").isNotNull().alias("has_time"),
        F.coalesce("p.value", "p.event_id").isNotNull().alias("has_number"),
    )


# Aggregates


@query("""
SELECT upper(l.state_code) AS state_code, metric_name, round(avg(metric_value), 6) AS avg_value,
       count(metric_value) AS n
FROM orders_tall t JOIN orders_locations l ON l.id = t.location_id
WHERE metric_value IS NOT NULL AND l.state_code IS NOT NULL GROUP BY ALL
""")
def avg_by_state(spark, sf):
    load = orders_load(spark, sf, staged=True)
    out = A.avg_by_state(PY.to_observations(load.facts, ORDER_FIELDS), load.locations)
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("""
SELECT metric_name, round(min(a), 6) AS min_value, round(max(a), 6) AS max_value FROM (
  SELECT l.state_code, metric_name, avg(metric_value) AS a
  FROM orders_tall t JOIN orders_locations l ON l.id = t.location_id
  WHERE metric_value IS NOT NULL GROUP BY ALL) GROUP BY metric_name
""")
def value_domain(spark, sf):
    load = orders_load(spark, sf, staged=True)
    out = A.value_domain(A.avg_by_state(PY.to_observations(load.facts, ORDER_FIELDS), load.locations))
    return out.select(
        "metric_name", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value")
    )


@query("""
SELECT t.id AS time_id, metric_name, round(avg(metric_value), 6) AS avg_value,
       count(metric_value) AS n, t.year, t.quarter, t.month, t.day, t.date_floor
FROM orders_tall o JOIN orders_times t ON t.id = o.time_id
WHERE metric_value IS NOT NULL GROUP BY ALL
""")
def avg_by_period(spark, sf):
    load = orders_load(spark, sf, staged=True)
    out = A.avg_by_period(PY.to_observations(load.facts), load.times)
    return out.select(
        "time_id", "metric_name", F.round("avg_value", 6).alias("avg_value"), "n", "year", "quarter",
        "month", "day", "date_floor",
    )


@query("""
SELECT l.county, t.year, t.quarter, round(avg(total_price), 6) AS avg_value, count(total_price) AS n
FROM orders_linked n LEFT JOIN orders_locations l ON l.id = n.location_id
LEFT JOIN orders_times t ON t.id = n.time_id GROUP BY ALL
""")
def avg_order_by_quarter_and_place(spark, sf):
    """Average order value by quarter and place, end to end from the text feed."""
    load = orders_load(spark, sf, staged=True)
    star = A.star_view(load.facts, load.locations, load.times)
    value = PY.parsed(["total_price"])["total_price"].cast("double")
    out = A.avg_by(star.withColumn("v", value), ["county", "year", "quarter"], F.col("v"))
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("""
SELECT count(*) AS observations, count(DISTINCT source_name) AS sources,
       count(DISTINCT location_id) AS locations, count(DISTINCT metric_name) AS metrics
FROM orders_tall
""")
def overview(spark, sf):
    return A.overview(PY.to_observations(orders_load(spark, sf).facts))


@query("SELECT DISTINCT metric_name FROM orders_tall")
def metric_names(spark, sf):
    return A.metric_names(PY.to_observations(orders_load(spark, sf).facts))


# Runs of the line feed by return flag, with the facts of each.
def line_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    feed = FD.clean(Q.lines_feed(spark, sf))
    raw = feed.select(F.lit("lines").alias("source_name"), F.col("l_returnflag").alias("ingest_run_id"))
    rows = fact_load(feed.withColumn(ROW, F.struct(ROW, "l_returnflag")), Q.LINES).facts
    facts = KP.first_per_key(rows, "id", ROW)
    return raw, facts.withColumn("ingest_run_id", F.col(f"{ROW}.l_returnflag"))


@query("""
SELECT 'lines' AS source_name, l_returnflag AS ingest_run_id, count(*) AS rows_read,
       count(*) FILTER (rn = 1) AS inserted, count(*) FILTER (rn > 1) AS not_inserted
FROM lines_rows GROUP BY l_returnflag
""")
def run_summary(spark, sf):
    """Rows read, facts inserted, rows that gave none, per run."""
    return A.run_summary(*line_runs(spark, sf))


# Across sources, lineage, integrity


def export_of(spark, sf, feed: DataFrame, source: SourceConfig) -> DataFrame:
    load = fact_load(FD.clean(feed), source, P.country_of_path(F.col(FILE)), folder=staging(spark))
    facts = load.facts.withColumn("ingest_run_id", F.lit("run"))
    return EX.export_frame(facts, load.locations, load.times, source.schema)


@query("""
SELECT o.fips_code, o.year, o.a AS avg_total_price, o.n AS n_a, s.a AS avg_acct_balance, s.n AS n_b
FROM (SELECT fips_code, year, round(avg(total_price), 6) AS a, count(total_price) AS n
      FROM orders_linked WHERE total_price IS NOT NULL GROUP BY ALL) o
JOIN (SELECT fips_code, year, round(avg(acct_balance), 6) AS a, count(acct_balance) AS n
      FROM suppliers_linked GROUP BY ALL) s ON o.fips_code = s.fips_code AND o.year = s.year
""")
def join_sources(spark, sf):
    """Two exported sources side by side, per place and year."""
    orders = export_of(spark, sf, Q.orders_feed(spark, sf), Q.ORDERS)
    suppliers = export_of(
        spark, sf, Q.suppliers_feed(spark, sf), changed(Q.SUPPLIERS, unique_key=("supplier_key",))
    )
    out = A.join_sources(orders, suppliers, "total_price", "acct_balance")
    return out.withColumns(
        {c: F.round(c, 6) for c in ("avg_total_price", "avg_acct_balance")}
    )


@query(f"""
SELECT 'orders' AS source_name, 'run' AS ingest_run_id, l.state_code, NULL :: VARCHAR AS state_name,
       l.county, l.fips_code, t.year, t.quarter, t.month, {PAYLOAD_SQL}
FROM orders_linked n LEFT JOIN orders_locations l ON l.id = n.location_id
LEFT JOIN orders_times t ON t.id = n.time_id
""")
def export_frame(spark, sf):
    """Facts flat and typed, written by year and run and read back; the run was exported before,
    when it held other years."""
    df = export_of(spark, sf, Q.orders_feed(spark, sf), Q.ORDERS)
    path = f"{shared_folder(spark)}/export-{uuid.uuid4()}"
    earlier = df.withColumn("year", (F.col("year") - 3).cast("smallint"))
    EX.write_export(earlier, path)
    EX.write_export(df, path)
    return EX.read_export(spark, path, df.schema).select(*df.columns)


def raw_and_facts(spark, sf, load: FactLoad | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the order feed, dated by their order, and the facts that came of them."""
    feed = clean_orders(spark, sf)
    raw = FA.raw_rows(feed).select(
        F.lit("run").alias("ingest_run_id"),
        F.col(ROW).alias("raw_import_id"),
        F.col(FILE).alias("source_file"),
        "raw_data",
        F.to_timestamp(F.get_json_object("raw_data", "$.year")).alias("imported_at"),
    )
    facts = (load or orders_load(spark, sf)).facts.withColumns(
        {"ingest_run_id": F.lit("run"), "raw_import_id": F.col(ROW)}
    )
    return raw, facts


@query("""
SELECT n.id, n.k AS raw_import_id, c.file AS source_file, c.state AS raw_state
FROM orders_linked n JOIN orders_clean c ON n.k = c.k
""")
def with_raw(spark, sf):
    """Facts with the raw row they came from."""
    raw, facts = raw_and_facts(spark, sf)
    state = F.get_json_object("raw_data", "$.state").alias("raw_state")
    return A.with_raw(facts, raw).select("id", "raw_import_id", "source_file", state)


@query("SELECT k AS raw_import_id FROM orders_rows WHERE level = 1 AND year < 1999")
def orphaned_raw(spark, sf):
    """Old raw rows that no fact refers to."""
    raw, facts = raw_and_facts(spark, sf)
    now = F.lit("1999-01-01").cast("timestamp")
    return A.orphaned_raw(raw, facts, now).select("raw_import_id")


@query("""
WITH lost AS (SELECT * FROM orders_linked WHERE CAST(fips_code AS INTEGER) % 2 = 1)
SELECT 'fact_without_location' AS check, (SELECT count(*) FROM lost) AS violations
UNION ALL SELECT 'fact_without_time', (SELECT count(*) FROM orders_linked WHERE year < 1997)
UNION ALL SELECT 'fact_without_raw', (SELECT count(*) FROM orders_linked WHERE file NOT LIKE '%USA%')
UNION ALL SELECT 'repeated_fact_id', (SELECT count(*) FROM (SELECT id FROM lines_rows GROUP BY id HAVING count(*) > 1))
UNION ALL SELECT 'repeated_location_id', 0
UNION ALL SELECT 'repeated_time_id', 0
UNION ALL SELECT 'impossible_period', 0
""".replace("WITH lost AS (SELECT * FROM orders_linked WHERE CAST(fips_code AS INTEGER) % 2 = 1)\n", "")
    .replace("(SELECT count(*) FROM lost)", "(SELECT count(*) FROM orders_linked WHERE CAST(fips_code AS INTEGER) % 2 = 1)"))
def check_integrity(spark, sf):
    """Violations in a star with missing parents and repeated keys."""
    load = orders_load(spark, sf, staged=True)
    raw, facts = raw_and_facts(spark, sf, load)
    columns = ["id", "raw_import_id", "ingest_run_id", "location_id", "time_id"]
    none = F.lit(None).cast("string")
    lines = fact_load(FD.clean(Q.lines_feed(spark, sf)), Q.LINES).facts.select(
        "id",
        F.lit(None).cast("bigint").alias("raw_import_id"),
        none.alias("ingest_run_id"),
        none.alias("location_id"),
        none.alias("time_id"),
    )
    return A.check_integrity(
        facts.select(*columns).unionByName(lines),
        written(load.locations).filter(F.col("fips_code").cast("int") % 2 == 0),
        written(load.times).filter("year >= 1997"),
        raw.filter(F.col("source_file").contains("USA")),
    )


@query("""
SELECT 'fact_without_location' AS check, count(*) AS violations FROM orders_linked WHERE CAST(fips_code AS INTEGER) % 2 = 1
UNION ALL SELECT 'fact_without_time', count(*) FROM orders_linked WHERE year < 1997
UNION ALL SELECT 'fact_without_raw', 0 UNION ALL SELECT 'repeated_fact_id', 0
UNION ALL SELECT 'repeated_location_id', 0 UNION ALL SELECT 'repeated_time_id', 0 UNION ALL SELECT 'impossible_period', 0
""")
def check_changes(spark, sf):
    """Violations of a loaded warehouse, asked for before and after places and periods are taken away."""
    wh = loaded(spark, sf)
    IT.check_changes(wh)
    wh.write_snapshot("dim_location", wh.read("dim_location").filter(F.col("fips_code").cast("int") % 2 == 0))
    wh.write_snapshot("dim_time", wh.read("dim_time").filter("year >= 1997"))
    return IT.check_changes(wh)


# Whole jobs against a warehouse folder


def loaded(spark, sf, feed: DataFrame | None = None, source: SourceConfig = Q.ORDERS) -> Warehouse:
    wh = new_warehouse(spark)
    feed = Q.orders_feed(spark, sf) if feed is None else feed
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        J.ingest_feed(wh, source, one_run(feed, "run-1"))
    return wh


@query(f"""
SELECT id, location_id, time_id, {PAYLOAD_SQL} FROM orders_linked
""")
def fact_load_plan(spark, sf):
    """The fact load as one plan."""
    return flat(orders_load(spark, sf).facts, "id", "location_id", "time_id")


@query(f"""
SELECT n.id, n.location_id, n.time_id, {PAYLOAD_SQL}, l.county, t.date_floor
FROM orders_linked n LEFT JOIN orders_locations l ON l.id = n.location_id
LEFT JOIN orders_times t ON t.id = n.time_id
""")
def fact_load_job(spark, sf):
    """The fact load as a job: staged, audited, dimensions merged, facts published."""
    wh = loaded(spark, sf)
    star = A.star_view(
        wh.read("normalized_imports"), wh.read("dim_location"), wh.read("dim_time"), ["county"], ["date_floor"]
    )
    return flat(star, "id", "location_id", "time_id", "county", "date_floor")


# Files have no country in their path here, and written files have no order of
# their own, so that only what does not depend on either is compared.
@query(f"SELECT id, {PAYLOAD_SQL}, time_id FROM orders_linked")
def csv_load_job(spark, sf):
    """CSV files loaded as one job, a run each."""
    wh = new_warehouse(spark)
    files = write_csv(Q.orders_feed(spark, sf), f"{wh.path}/files")
    J.run_source(wh, changed(Q.ORDERS, files=tuple(files)))
    return flat(wh.read("normalized_imports"), "id", "time_id")


@query("""
SELECT 'orders' AS source_name, (SELECT count(*) FROM orders_linked) AS facts, 1 AS given_up
UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier), 0
""")
def run_all_job(spark, sf):
    """Two sources loaded, a missing file among them."""
    wh = new_warehouse(spark)
    orders = write_csv(Q.orders_feed(spark, sf), f"{wh.path}/orders")
    suppliers = write_csv(Q.suppliers_feed(spark, sf), f"{wh.path}/suppliers")
    sources = [
        changed(Q.ORDERS, files=(*orders, f"{wh.path}/missing.csv")),
        changed(Q.SUPPLIERS, unique_key=("supplier_key",), files=tuple(suppliers)),
    ]
    try:
        reports = J.run_all(wh, sources)
    except J.LoadFailed as e:
        reports = e.reports
    lost = [(r.source_name, int(r.error is not None)) for r in reports]
    failed = spark.createDataFrame(lost, "source_name string, n int").groupBy("source_name").agg(F.sum("n").alias("given_up"))
    facts = wh.read("normalized_imports").groupBy("source_name").agg(F.count(F.lit(1)).alias("facts"))
    return facts.join(failed, "source_name").select("source_name", "facts", "given_up")


@query("""
SELECT 'orders' AS source_name, id, time_id, order_key, total_price, NULL :: BIGINT AS supplier_key, NULL :: DOUBLE AS acct_balance
FROM orders_linked
UNION ALL SELECT 'suppliers', supplier_id, time_id, NULL, NULL, supplier_key, acct_balance FROM suppliers_by_key
""")
def run_all_facts(spark, sf):
    """The facts of two sources loaded together, a missing file among them."""
    wh = new_warehouse(spark)
    orders = write_csv(Q.orders_feed(spark, sf), f"{wh.path}/orders")
    suppliers = write_csv(Q.suppliers_feed(spark, sf), f"{wh.path}/suppliers")
    sources = [
        changed(Q.ORDERS, files=(*orders, f"{wh.path}/missing.csv")),
        changed(Q.SUPPLIERS, unique_key=("supplier_key",), files=tuple(suppliers)),
    ]
    try:
        J.run_all(wh, sources)
    except J.LoadFailed:
        pass
    p = PY.parsed(["order_key", "total_price", "supplier_key", "acct_balance"])
    return wh.read("normalized_imports").select("source_name", "id", "time_id", p.alias("p")).select(
        "source_name", "id", "time_id", F.col("p.order_key").cast("bigint").alias("order_key"),
        F.col("p.total_price").cast("double").alias("total_price"), F.col("p.supplier_key").cast("bigint").alias("supplier_key"),
        F.col("p.acct_balance").cast("double").alias("acct_balance"),
    )


@query("""
SELECT 'facts' AS what, 0 AS n UNION ALL SELECT 'places', 0 UNION ALL SELECT 'given up', 1
UNION ALL SELECT 'raw_rows', count(*) FROM orders_rows
""")
def abort_job(spark, sf):
    """A failure whose policy gives the file up: no facts, no places, raw rows kept."""
    wh = new_warehouse(spark)
    try:
        J.ingest_feed(wh, STRICT_ORDERS, one_run(Q.orders_feed(spark, sf), "run-1"))
    except J.LoadFailed:
        pass
    counts = {
        name: wh.read(t).agg(F.count(F.lit(1)).alias(name))
        for name, t in (("facts", "normalized_imports"), ("places", "dim_location"), ("raw_rows", "raw_imports"))
    }
    rows = [df.select(F.lit(name).alias("what"), F.col(name).alias("n")) for name, df in counts.items()]
    rows.append(wh.read("run_log").groupBy(F.col("status").alias("what")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, rows)


@query(f"SELECT id, {PAYLOAD_SQL}, time_id FROM orders_linked")
def stream_load_job(spark, sf):
    """The same files picked up as they arrive."""
    wh = new_warehouse(spark)
    feed = Q.orders_feed(spark, sf)
    write_csv(feed, f"{wh.path}/files")
    header = FD.feed_columns(feed)
    q = stream_ingest(wh, Q.ORDERS, f"{wh.path}/files", header, f"{wh.path}/progress")
    q.awaitTermination()
    return flat(wh.read("normalized_imports"), "id", "time_id")


def write_by_country(spark, sf, folder: str) -> list[str]:
    """The order feed as CSV files below folders that tell the country, or none, as the feed's own paths do."""
    feed, usa = Q.orders_feed(spark, sf), F.col(FILE).contains("/USA/")
    return write_csv(feed.filter(usa), f"{folder}/usa") + write_csv(feed.filter(~usa), f"{folder}/usable")


@query(f"SELECT id, {PAYLOAD_SQL}, location_id, time_id FROM orders_linked")
def csv_load_links(spark, sf):
    """CSV files of two folders loaded as one job, with both links of every fact."""
    wh = new_warehouse(spark)
    files = write_by_country(spark, sf, f"{wh.path}/files")
    J.run_source(wh, changed(Q.ORDERS, files=tuple(files)))
    return flat(wh.read("normalized_imports"), "id", "location_id", "time_id")


@query(f"SELECT id, {PAYLOAD_SQL}, location_id, time_id FROM orders_linked")
def stream_load_links(spark, sf):
    """The same files as they arrive, with both links of every fact."""
    wh = new_warehouse(spark)
    write_by_country(spark, sf, f"{wh.path}/files")
    header = FD.feed_columns(Q.orders_feed(spark, sf))
    stream_ingest(wh, Q.ORDERS, f"{wh.path}/files/*", header, f"{wh.path}/progress").awaitTermination()
    return flat(wh.read("normalized_imports"), "id", "location_id", "time_id")


@query(f"SELECT id, {PAYLOAD_SQL} FROM orders_linked")
def replay_job(spark, sf):
    """Facts made again from the audit rows."""
    wh = loaded(spark, sf)
    J.replay(wh, Q.ORDERS)
    return flat(wh.read("normalized_imports"), "id")


@query("""
SELECT id, order_key, priority, region_name, status, NULL :: DOUBLE AS total_price, 'run-1' AS ingest_run_id
FROM orders_linked
""")
def replay_changed(spark, sf):
    """Facts made again under the same definition, which writes nothing, then under one whose totals are whole
    numbers, which none of them is."""
    wh = loaded(spark, sf)
    wh.derived.create("fact_digests")
    before = wh.read("normalized_imports").inputFiles()
    J.replay(wh, Q.ORDERS)
    if sorted(wh.read("normalized_imports").inputFiles()) != sorted(before):
        raise AssertionError("facts that did not change were written again")
    whole = tuple(FieldDef("Total", "total_price", "integer") if f.canonical == "total_price" else f for f in Q.ORDERS.fields)
    J.replay(wh, changed(Q.ORDERS, fields=whole))
    return flat(wh.read("normalized_imports"), "id", "ingest_run_id")


@query(f"SELECT id, {PAYLOAD_SQL} FROM orders_linked WHERE year < 1998")
def rollback_run(spark, sf):
    """Two runs loaded, the second rolled back."""
    feed = Q.orders_feed(spark, sf)
    early = F.col("Year") < "1998"
    wh = loaded(spark, sf, feed.filter(early))
    J.ingest_feed(wh, Q.ORDERS, one_run(feed.filter(~early), "run-2"))
    wh.rollback_run("run-2")
    return flat(wh.read("normalized_imports"), "id")


# What is kept beside the facts


def kept(spark, sf, *tables: str) -> Warehouse:
    """Orders in three runs, with the given tables kept up: one before 1998, one of everything, of which
    only what is new goes in, and, after the first is rolled back, one of everything again. All that
    is left is then made again from the audit rows."""
    wh = new_warehouse(spark)
    for name in tables:
        wh.derived.create(name)
    feed = Q.orders_feed(spark, sf)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        J.ingest_feed(wh, Q.ORDERS, one_run(feed.filter(F.col("Year") < "1998"), "run-1"))
        J.ingest_feed(wh, Q.ORDERS, one_run(feed, "run-2"))
        wh.rollback_run("run-1")
        J.ingest_feed(wh, Q.ORDERS, one_run(feed, "run-3"))
    return wh


@query(f"SELECT id, {PAYLOAD_SQL}, CASE WHEN year < 1998 THEN 'run-3' ELSE 'run-2' END AS ingest_run_id FROM orders_linked")
def insert_by_bucket(spark, sf):
    """Conflicts found in the id index, which follows loads and a rollback."""
    return flat(kept(spark, sf).read("normalized_imports"), "id", "ingest_run_id")


@query("SELECT id, CASE WHEN year < 1998 THEN 'run-3' ELSE 'run-2' END AS ingest_run_id FROM orders_linked")
def id_index(spark, sf):
    """The ids that the index holds, made anew with another number of buckets."""
    wh = kept(spark, sf)
    wh.derived.ids.rebuild(buckets=5)
    return wh.derived.ids.live().select("id", "ingest_run_id")


@query("SELECT id, total_price AS price, try_cast(priority AS DOUBLE) AS priority FROM orders_linked")
def stored_payload_field(spark, sf):
    """Payload fields from the columns of the parsed payload."""
    values = kept(spark, sf, "fact_values").derived.read("fact_values")
    price = RT.value_field(values, "total_price", "double", "price")
    return RT.value_field(price, "priority", "double").select("id", "price", "priority")


@query("SELECT id, metric_name, metric_value FROM orders_tall")
def stored_observations(spark, sf):
    """One row per fact and field, from the parsed payload."""
    values = kept(spark, sf, "fact_values").derived.read("fact_values")
    return RT.value_observations(values, ORDER_FIELDS).select("id", "metric_name", "metric_value")


@query(f"""
SELECT 'orders' AS source_name, CASE WHEN n.year < 1998 THEN 'run-3' ELSE 'run-2' END AS ingest_run_id, l.state_code,
       NULL :: VARCHAR AS state_name, l.county, l.fips_code, t.year, t.quarter, t.month, {PAYLOAD_SQL}
FROM orders_linked n LEFT JOIN orders_locations l ON l.id = n.location_id
LEFT JOIN orders_times t ON t.id = n.time_id
""")
def stored_export(spark, sf):
    """The flat, typed form of the facts from the parsed payload."""
    wh = kept(spark, sf, "fact_values")
    values = wh.derived.read("fact_values")
    return EX.export_frame(values, wh.read("dim_location"), wh.read("dim_time"), Q.ORDERS.schema)


@query(f"SELECT id, {PAYLOAD_SQL} FROM orders_linked WHERE priority = '1-URGENT' AND status = 'O'")
def contains_by_terms(spark, sf):
    """Payload containment from the postings, kept up through loads, a rollback and a replay."""
    wh = kept(spark, sf, "payload_terms")
    J.replay(wh, Q.ORDERS)
    wanted = {"priority": "1-URGENT", "status": "O"}
    return flat(RT.contains_by_terms(wh.read("normalized_imports"), wh.derived.read("payload_terms"), wanted), "id")


STATE_MEANS = """
SELECT upper(l.state_code) AS state_code, metric_name, round(avg(metric_value), 6) AS avg_value,
       count(metric_value) AS n
FROM orders_tall t JOIN orders_locations l ON l.id = t.location_id
WHERE metric_value IS NOT NULL AND l.state_code IS NOT NULL GROUP BY ALL
"""


@query(STATE_MEANS)
def stored_avg_by_state(spark, sf):
    """Means by state from sums that each run left."""
    wh = kept(spark, sf, "metric_partials")
    J.replay(wh, Q.ORDERS)
    sums = A.stored_sums(wh.derived.read("metric_partials"), "location_id")
    return A.state_means(sums, wh.read("dim_location")).withColumn("avg_value", F.round("avg_value", 6))


@query("""
SELECT t.id AS time_id, metric_name, round(avg(metric_value), 6) AS avg_value,
       count(metric_value) AS n, t.year, t.quarter, t.month, t.day, t.date_floor
FROM orders_tall o JOIN orders_times t ON t.id = o.time_id
WHERE metric_value IS NOT NULL GROUP BY ALL
""")
def stored_avg_by_period(spark, sf):
    """Means by period from sums that each run left."""
    wh = kept(spark, sf, "metric_partials")
    sums = A.stored_sums(wh.derived.read("metric_partials"), "time_id")
    return A.period_means(sums, wh.read("dim_time")).withColumn("avg_value", F.round("avg_value", 6))


@query(f"SELECT metric_name, round(min(avg_value), 6) AS min_value, round(max(avg_value), 6) AS max_value FROM ({STATE_MEANS}) GROUP BY metric_name")
def stored_value_domain(spark, sf):
    """Lowest and highest mean of each metric, from the same sums."""
    wh = kept(spark, sf, "metric_partials")
    sums = A.stored_sums(wh.derived.read("metric_partials"), "location_id")
    out = A.value_domain(A.state_means(sums, wh.read("dim_location")))
    return out.select("metric_name", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"))


@query("""
SELECT count(*) AS observations, count(DISTINCT source_name) AS sources,
       count(DISTINCT location_id) AS locations, count(DISTINCT metric_name) AS metrics
FROM orders_tall
""")
def stored_overview(spark, sf):
    """The overview without a look at facts."""
    return A.stored_overview(kept(spark, sf, "metric_partials").derived.read("metric_partials"))


@query(f"""
SELECT id, {PAYLOAD_SQL} FROM orders_linked WHERE id > '80000000-0000-5000-8000-000000000000' ORDER BY id LIMIT 100
""")
def clustered_page(spark, sf):
    """The page behind an id, from files laid out by id."""
    wh = kept(spark, sf, "fact_pages")
    return flat(wh.derived.page("fact_pages", "80000000-0000-5000-8000-000000000000", 100), "id")


@query("""
SELECT count(*) AS observations, count(DISTINCT source_name) AS sources,
       count(DISTINCT location_id) AS locations, count(DISTINCT metric_name) AS metrics
FROM orders_tall
""")
def bitmap_overview(spark, sf):
    """The overview from bitmaps of numbered keys, which each run left."""
    return A.bitmap_overview(kept(spark, sf, "key_bitmaps").derived.read("key_bitmaps"))


@query("""
SELECT metric_name, min(metric_value) AS least, max(metric_value) AS most, count(*) AS n
FROM orders_tall WHERE metric_value IS NOT NULL GROUP BY metric_name
""")
def metric_ranges(spark, sf):
    """Lowest and highest value of each metric, without a look at facts."""
    return A.metric_ranges(kept(spark, sf, "metric_partials").derived.read("metric_partials"))


@query("SELECT id, county, population, density FROM places_rows")
def dimension_load_job(spark, sf):
    """A dimension file loaded as a job."""
    wh = new_warehouse(spark)
    feed = Q.places_feed(spark, sf).coalesce(1)
    (path,) = write_csv(feed, f"{wh.path}/files")
    J.run_dim(wh, changed(Q.PLACES, files=(path,)))
    return wh.read("dim_location").select("id", "county", "population", "density")


@query("""
SELECT 'places' AS source_name, 'dim_location' AS target, count(*) AS row_count FROM nation
UNION ALL SELECT 'places', 'dim_location', count(*) FROM nation WHERE n_nationkey % 2 = 1
""")
def dimension_log(spark, sf):
    """The log of dimension loads after loading two files."""
    wh = new_warehouse(spark)
    files = []
    for second in (False, True):
        feed = Q.places_feed(spark, sf, second).coalesce(1)
        files += write_csv(feed, f"{wh.path}/files-{second}")
    J.run_all_dims(wh, [changed(Q.PLACES, files=tuple(files))])
    return wh.read("dim_file_log").select("source_name", "target", "row_count")


@query("""
SELECT id, county, country, fips_code, state_code, NULL :: SMALLINT AS year, NULL :: SMALLINT AS quarter,
       NULL :: SMALLINT AS month, NULL :: SMALLINT AS day, NULL :: DATE AS date_floor FROM orders_locations
UNION ALL SELECT id, NULL, NULL, NULL, NULL, year, quarter, month, day, date_floor FROM orders_times
""")
def export_dimension_rows(spark, sf):
    """The rows of both dimensions as they are read back from the export."""
    wh = loaded(spark, sf)
    out = J.export_dims(wh, f"{wh.path}/exports")
    places = spark.read.parquet(out["dim_location"]).select("id", "county", "country", "fips_code", "state_code")
    times = spark.read.parquet(out["dim_time"]).select("id", "year", "quarter", "month", "day", "date_floor")
    return places.unionByName(times, allowMissingColumns=True)


@query("""
SELECT 'dim_location' AS dimension, count(*) AS rows FROM orders_locations
UNION ALL SELECT 'dim_time', count(*) FROM orders_times
""")
def export_dimensions(spark, sf):
    """Both dimensions written beside the exports, read back."""
    wh = loaded(spark, sf)
    out = J.export_dims(wh, f"{wh.path}/exports")
    sizes = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("dimension"), "rows")
        for t, path in out.items()
    ]
    return sizes[0].unionByName(sizes[1])
