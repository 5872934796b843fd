"""The given tables as messy text feeds, with a definition for each.

Every feed is a projection to text of whole tables, as if read from CSV.
Deterministic expressions of the row's key put in blanks, padding and bad
values. The SQL counterparts are in ``sqltext``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafact import DerivedDef, FieldDef, OnFailure, RuleDef, SourceConfig
from terrafact.functions.places import STATE_CODES
from terrafact.sources.feeds import FILE, ROW
from terrafact.sources.warehouse import configure

ORDERS = SourceConfig(
    name="orders",
    unique_key=("order_key",),
    fields=(
        FieldDef("Region", "region_name"),
        FieldDef(
            "State",
            "state_code",
            on_failure=OnFailure.SKIP_ROW,
            rules=(RuleDef("state_name_to_code"),),
        ),
        FieldDef("County", "county"),
        FieldDef("FIPS", "fips_code"),
        FieldDef("Year", "year", "smallint"),
        FieldDef("Quarter", "quarter", "smallint"),
        FieldDef("Month", "month", "smallint"),
        FieldDef("Day", "day", "smallint"),
        FieldDef("Total", "total_price", "float8"),
        FieldDef("Priority", "priority"),
        FieldDef("Status", "status"),
        FieldDef("Order", "order_key", "bigint"),
    ),
)

LINES = SourceConfig(
    name="lines",
    unique_key=("order_key", "line_number"),
    fields=(
        FieldDef("l_orderkey", "order_key", "bigint"),
        FieldDef("l_linenumber", "line_number", "integer"),
        FieldDef("l_quantity", "quantity", "numeric"),
        FieldDef("l_extendedprice", "price", "float8"),
        FieldDef("l_shipdate", "ship_date", "date"),
    ),
)

EVENTS = SourceConfig(
    name="events",
    unique_key=("event_id",),
    fields=(
        FieldDef("event", "event_id", "bigint"),
        FieldDef("at_rfc3339", "at_rfc3339", "timestamptz"),
        FieldDef("at_rfc2822", "at_rfc2822", "timestamptz", "rfc2822"),
        FieldDef("at_seconds", "at_seconds", "timestamptz", "unix_seconds"),
        FieldDef("at_millis", "at_millis", "timestamptz", "unix_millis"),
        FieldDef("at_us", "at_us", "timestamptz", "us_datetime"),
        FieldDef("user", "user_id", "integer"),
        FieldDef("kind", "kind"),
        FieldDef("value", "value", "numeric"),
        FieldDef("props", "props", "jsonb"),
        FieldDef("flag", "flag", "boolean"),
    ),
)

PLACES = SourceConfig(
    name="places",
    target="dim_location",
    unique_key=("country", "state_code", "fips_code", "city", "zip_code"),
    fields=(
        *(FieldDef(n, n) for n in ("country", "state_code", "state_name", "fips_code", "county")),
        FieldDef("city", "city"),
        FieldDef("population", "population", "float8"),
        FieldDef("density", "density", "float8"),
        FieldDef("weights", "county_weights", "json"),
        FieldDef("military", "military"),
        FieldDef("zip", "zip_code", "integer"),
        FieldDef("latitude", "latitude", "real"),
        FieldDef("longitude", "longitude"),
    ),
)

CALENDAR = SourceConfig(
    name="calendar",
    target="dim_time",
    unique_key=("year", "quarter", "month", "day"),
    fields=tuple(FieldDef(n, n, "smallint") for n in ("year", "quarter", "month", "day")),
)

SUPPLIERS = SourceConfig(
    name="suppliers",
    unique_key=("location_id", "time_id"),
    fields=(
        FieldDef("fips", "fips_code"),
        FieldDef("county", "county"),
        FieldDef("year", "year", "smallint"),
        FieldDef("balance", "acct_balance", "float8"),
        FieldDef("supplier", "supplier_key", "bigint"),
    ),
)

ENRICHED = SourceConfig(
    **{
        **{k: v for k, v in ORDERS.__dict__.items() if k != "by_canonical"},
        "derived": (
            DerivedDef("place_name", "dim_location", "state_name", match="state_code"),
            DerivedDef("place_zone", "dim_location", "timezone", match="state_code"),
        ),
    }
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _messy(key: Column, text: Column) -> Column:
    return (
        F.when(key % 11 == 0, F.lit(""))
        .when(key % 13 == 0, F.lit("n/a"))
        .when(key % 7 == 0, F.concat(F.lit("  "), text, F.lit(" \t")))
        .otherwise(text)
    )


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _state_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in STATE_CODES]), number)


def orders_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the place of their customer; one row per order."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    state = (
        F.when(k % 29 == 0, F.lit("Atlantis"))
        .when(k % 7 == 0, F.concat(F.lit(" "), _state_name(F.col("n_nationkey"))))
        .otherwise(_state_name(F.col("n_nationkey")))
    )
    quarter = (
        F.when(k % 17 == 0, F.lit("5"))
        .when(k % 19 == 0, F.lit(" "))
        .otherwise(F.quarter(at).cast("string"))
    )
    county = F.when(k % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    path = F.when(F.col("r_regionkey") % 2 == 0, F.lit("feeds/USA/orders.csv")).otherwise(
        F.lit("feeds/usable/orders.csv")
    )
    return joined.select(
        F.col("r_name").alias("Region"),
        state.alias("State"),
        county.alias("County"),
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("FIPS"),
        F.year(at).cast("string").alias("Year"),
        quarter.alias("Quarter"),
        F.month(at).cast("string").alias("Month"),
        F.dayofmonth(at).cast("string").alias("Day"),
        _messy(k, _money("o_totalprice")).alias("Total"),
        F.col("o_orderpriority").alias("Priority"),
        F.col("o_orderstatus").alias("Status"),
        k.cast("string").alias("Order"),
        path.alias(FILE),
        k.alias(ROW),
    )


def lines_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Line items; keys repeat, the lowest row in text order comes first."""
    texts = [
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        _money("l_quantity").alias("l_quantity"),
        _money("l_extendedprice").alias("l_extendedprice"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
        F.col("l_returnflag"),
    ]
    df = table(spark, sf, "lineitem").select(*texts)
    order = F.struct("l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    return df.select("*", F.lit("feeds/lines.csv").alias(FILE), order.alias(ROW))


def events_feed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    at = F.col("ts")
    seconds = F.unix_seconds(at.cast("timestamp"))
    words = ("yes", "no", "1", "0", "TRUE", "False", "maybe")
    flag = F.get(F.array(*[F.lit(x) for x in words]), (k % 7).cast("int"))
    props = (
        F.when(k % 34 == 0, F.concat(F.col("props"), F.lit(" x")))
        .when(k % 17 == 0, F.lit('{"k": 69'))
        .otherwise(F.col("props"))
    )

    def bad(text: Column) -> Column:
        return F.when(k % 13 == 0, F.lit("never")).when(k % 11 == 0, F.lit("")).otherwise(text)

    return table(spark, sf, "events").select(
        k.cast("string").alias("event"),
        bad(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias(
            "at_rfc3339"
        ),
        bad(F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias(
            "at_rfc2822"
        ),
        bad(seconds.cast("string")).alias("at_seconds"),
        bad((F.unix_millis(at.cast("timestamp"))).cast("string")).alias("at_millis"),
        bad(F.date_format(at, "MM/dd/yyyy HH:mm:ss")).alias("at_us"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("kind"),
        _messy(k, _money("value")).alias("value"),
        props.alias("props"),
        flag.alias("flag"),
        F.lit("feeds/events.csv").alias(FILE),
        k.alias(ROW),
    )


def places_feed(spark: SparkSession, sf: str, second: bool = False) -> DataFrame:
    """One row per nation with its customers counted; the second batch knows
    other populations for odd nations and no densities."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    people = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    k = F.col("n_nationkey")
    df = nation.join(people, k == F.col("c_nationkey"), "left")
    count = F.coalesce(F.col("people"), F.lit(0))
    if second:
        df = df.filter(k % 2 == 1)
        count = count + 1000
    density = F.lit("") if second else (count / (F.col("n_regionkey") + 1)).cast("decimal(18,2)").cast("string")
    return df.select(
        F.lit("US").alias("country"),
        _code(k).alias("state_code"),
        _state_name(k).alias("state_name"),
        F.lpad(k.cast("string"), 5, "0").alias("fips_code"),
        F.col("n_name").alias("county"),
        count.cast("string").alias("population"),
        density.alias("density"),
        F.when(k % 3 == 0, F.lit("{}x")).otherwise(F.concat(F.lit('{"w": '), k.cast("string"), F.lit("}"))).alias(
            "weights"
        ),
        F.get(F.array(*[F.lit(x) for x in ("yes", "0", "perhaps")]), k % 3).alias("military"),
        (k + 10000).cast("string").alias("zip"),
        (k / 4).cast("decimal(18,2)").cast("string").alias("latitude"),
        F.concat(F.lit("-"), k.cast("string"), F.lit(".5")).alias("longitude"),
        F.lit("feeds/places.csv").alias(FILE),
        k.cast("bigint").alias(ROW),
    )


def _code(number: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in STATE_CODES.values()]), number)


def calendar_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as calendar parts, and entries that are odd for every year."""
    at = F.col("o_orderdate")
    orders = table(spark, sf, "orders")
    days = orders.select(
        F.year(at).alias("year"),
        F.quarter(at).alias("quarter"),
        F.month(at).alias("month"),
        F.dayofmonth(at).alias("day"),
    )
    none = F.lit(None).cast("int")
    odd = [
        (F.lit(5), none, none),
        (none, F.lit(13), none),
        (none, F.lit(2), F.lit(30)),
        (F.quarter(at), none, none),
        (none, none, F.lit(32)),
    ]
    for q, m, d in odd:
        days = days.unionByName(
            orders.select(
                F.year(at).alias("year"), q.alias("quarter"), m.alias("month"), d.alias("day")
            )
        )
    texts = [F.col(c).cast("string").alias(c) for c in ("year", "quarter", "month", "day")]
    order = F.struct("year", "quarter", "month", "day")
    return days.select(*texts).select(
        "*", F.lit("feeds/calendar.csv").alias(FILE), order.alias(ROW)
    )


def suppliers_feed(spark: SparkSession, sf: str) -> DataFrame:
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("fips"),
        F.col("n_name").alias("county"),
        (k % 7 + 1995).cast("string").alias("year"),
        _money("s_acctbal").alias("balance"),
        k.cast("string").alias("supplier"),
        F.lit("feeds/suppliers.csv").alias(FILE),
        k.alias(ROW),
    )
