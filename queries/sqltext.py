"""SQL counterparts of the feeds and of the steps every query builds on.

``with_steps(body)`` puts the common table expressions in front of a query.
"""

from __future__ import annotations

from terrafact.functions.coerce import DECIMAL, SIGNED
from terrafact.functions.keys import OID_NAMESPACE
from terrafact.functions.places import STATE_CODES


def _list(texts) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def state_code(c: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in STATE_CODES.items())
    return f"CASE {c} {cases} END"


def uuid5(text: str) -> str:
    namespace = "".join(f"\\x{OID_NAMESPACE[i:i + 2].upper()}" for i in range(0, 32, 2))
    h = f"sha1('{namespace}'::BLOB || encode({text}))"
    variant = f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"{variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


def integer(c: str, sql_type: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{SIGNED}') THEN try_cast({c} AS {sql_type}) END"


def number(c: str, sql_type: str = "DOUBLE") -> str:
    return f"CASE WHEN regexp_matches({c}, '{DECIMAL}') THEN try_cast({c} AS {sql_type}) END"


def float_bits(c: str, bias: int, digits: int) -> str:
    """IEEE bits of a positive number: its exponent, put right where the logarithm is rounded, and its digits."""
    e = f"floor(log2({c}))"
    e = f"({e} + CASE WHEN {c} < pow(2.0, {e}) THEN -1 WHEN {c} >= pow(2.0, {e} + 1) THEN 1 ELSE 0 END)"
    bits = f"CAST({e} + {bias} AS HUGEINT) * {2**digits} + CAST(({c} / pow(2.0, {e}) - 1) * {2**digits} AS HUGEINT)"
    return f"coalesce(CAST({bits} AS VARCHAR), '')"


def clean(c: str) -> str:
    return f"nullif(trim({c}, E' \\t'), '')"


def messy(key: str, text: str) -> str:
    return (
        f"CASE WHEN {key} % 11 = 0 THEN '' WHEN {key} % 13 = 0 THEN 'n/a' "
        f"WHEN {key} % 7 = 0 THEN '  ' || {text} || E' \\t' ELSE {text} END"
    )


def money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def floor_of(year: str, quarter: str, month: str, day: str) -> str:
    first = f"coalesce({month}, ({quarter} - 1) * 3 + 1, 1)"
    return (
        f"try_cast(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || "
        f"lpad(CAST({first} AS VARCHAR), 2, '0') || '-' || "
        f"lpad(CAST(coalesce({day}, 1) AS VARCHAR), 2, '0') AS DATE)"
    )


def within(c: str, low: int, high: int) -> str:
    return f"CASE WHEN {c} BETWEEN {low} AND {high} THEN {c} END"


STATES, CODES = _list(STATE_CODES), _list(STATE_CODES.values())
LOCATION_TEXT = (
    "'city=|country=' || coalesce(country, '') || '|fips_code=' || coalesce(fips_code, '') || "
    "'|state_code=' || coalesce(state_code, '') || '|zip_code='"
)
TIME_TEXT = (
    "'day=' || coalesce(CAST(day AS VARCHAR), '') || '|month=' || "
    "coalesce(CAST(month AS VARCHAR), '') || '|quarter=' || "
    "coalesce(CAST(quarter AS VARCHAR), '') || '|year=' || CAST(year AS VARCHAR)"
)

STEPS = {
    "orders_feed": f"""
SELECT r_name AS region,
       CASE WHEN o_orderkey % 29 = 0 THEN 'Atlantis'
            WHEN o_orderkey % 7 = 0 THEN ' ' || ({STATES})[n_nationkey + 1]
            ELSE ({STATES})[n_nationkey + 1] END AS state,
       CASE WHEN o_orderkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS county,
       lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips,
       CAST(year(o_orderdate) AS VARCHAR) AS year,
       CASE WHEN o_orderkey % 17 = 0 THEN '5' WHEN o_orderkey % 19 = 0 THEN ' '
            ELSE CAST(quarter(o_orderdate) AS VARCHAR) END AS quarter,
       CAST(month(o_orderdate) AS VARCHAR) AS month,
       CAST(day(o_orderdate) AS VARCHAR) AS day,
       {messy("o_orderkey", money("o_totalprice"))} AS total,
       o_orderpriority AS priority, o_orderstatus AS status,
       CAST(o_orderkey AS VARCHAR) AS "order",
       CASE WHEN r_regionkey % 2 = 0 THEN 'feeds/USA/orders.csv'
            ELSE 'feeds/usable/orders.csv' END AS file,
       o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "orders_clean": "SELECT "
    + ", ".join(
        f"{clean(c)} AS {c}"
        for c in (
            "region",
            "state",
            "county",
            "fips",
            "year",
            "quarter",
            "month",
            "day",
            "total",
            "priority",
            "status",
            '"order"',
        )
    )
    + ", file, k FROM orders_feed",
    "orders_rows": f"""
SELECT region AS region_name, {state_code("state")} AS state_code, county, fips AS fips_code,
       {integer("year", "SMALLINT")} AS year, {integer("quarter", "SMALLINT")} AS quarter,
       {integer("month", "SMALLINT")} AS month, {integer("day", "SMALLINT")} AS day,
       {number("total")} AS total_price, priority, status,
       {integer('"order"', "BIGINT")} AS order_key, file, k, state, total,
       CASE WHEN state IS NOT NULL AND {state_code("state")} IS NULL THEN 1 ELSE 0 END AS level,
       CASE WHEN list_contains(string_split(lower(file), '/'), 'usa') THEN 'US' END AS country
FROM orders_clean""",
    "orders_linked": f"""
SELECT *, CASE WHEN coalesce(county, country, fips_code) IS NOT NULL
               THEN {uuid5(LOCATION_TEXT)} END AS location_id,
       CASE WHEN year IS NOT NULL THEN {uuid5(TIME_TEXT)} END AS time_id,
       {uuid5("'order_key=' || coalesce(CAST(order_key AS VARCHAR), '')")} AS id
FROM orders_rows WHERE level = 0""",
    "orders_locations": """
SELECT location_id AS id, arg_min(county, k) AS county, arg_min(country, k) AS country,
       arg_min(fips_code, k) AS fips_code, arg_min(state_code, k) AS state_code
FROM orders_linked WHERE location_id IS NOT NULL GROUP BY location_id""",
    "orders_times": f"""
SELECT DISTINCT time_id AS id, year, {within("quarter", 1, 4)} AS quarter,
       {within("month", 1, 12)} AS month, {within("day", 1, 31)} AS day,
       {floor_of("year", within("quarter", 1, 4), within("month", 1, 12), within("day", 1, 31))}
           AS date_floor
FROM orders_linked WHERE time_id IS NOT NULL""",
    "lines_feed": f"""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       {money("l_quantity")} AS l_quantity, {money("l_extendedprice")} AS l_extendedprice,
       strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_returnflag
FROM lineitem""",
    "lines_rows": f"""
SELECT *, {uuid5("'line_number=' || l_linenumber || '|order_key=' || l_orderkey")} AS id,
       CAST(l_orderkey AS BIGINT) AS order_key, CAST(l_linenumber AS INTEGER) AS line_number,
       CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price,
       CAST(l_shipdate AS DATE) AS ship_date,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                          ORDER BY l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS rn
FROM lines_feed""",
    "events_feed": f"""
SELECT CAST(event_id AS VARCHAR) AS event,
       {{bad}}strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS at_rfc3339,
       {{bad}}strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' END AS at_rfc2822,
       {{bad}}CAST(epoch_us(ts) // 1000000 AS VARCHAR) END AS at_seconds,
       {{bad}}CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS at_millis,
       {{bad}}strftime(ts, '%m/%d/%Y %H:%M:%S') END AS at_us,
       CAST(user_id AS VARCHAR) AS "user", event_type AS kind,
       {messy("event_id", money("value"))} AS value,
       CASE WHEN event_id % 34 = 0 THEN props || ' x' WHEN event_id % 17 = 0 THEN '{{{{"k": 69'
            ELSE props END AS props,
       (['yes', 'no', '1', '0', 'TRUE', 'False', 'maybe'])[event_id % 7 + 1] AS flag,
       event_id AS k
FROM events""".format(
        bad="CASE WHEN event_id % 13 = 0 THEN 'never' WHEN event_id % 11 = 0 THEN '' ELSE "
    ),
    "events_rows": f"""
SELECT k AS event_id,
       epoch_us(CAST(try_strptime({clean("at_rfc3339")}, '%Y-%m-%dT%H:%M:%S.%fZ') AS TIMESTAMP))
           AS at_rfc3339,
       epoch_us(CAST(try_strptime({clean("at_rfc2822")}, '%a, %d %b %Y %H:%M:%S +0000')
           AS TIMESTAMP)) AS at_rfc2822,
       {integer(clean("at_seconds"), "BIGINT")} * 1000000 AS at_seconds,
       {integer(clean("at_millis"), "BIGINT")} * 1000 AS at_millis,
       epoch_us(CAST(try_strptime({clean("at_us")}, '%m/%d/%Y %H:%M:%S') AS TIMESTAMP)) AS at_us,
       {integer('"user"', "INTEGER")} AS user_id, kind, {number(clean("value"))} AS value,
       CASE WHEN json_valid(props) THEN props END AS props,
       CASE WHEN lower(flag) IN ('true', '1', 'yes') THEN true
            WHEN lower(flag) IN ('false', '0', 'no') THEN false END AS flag
FROM events_feed""",
    "places_first": f"""
SELECT n_nationkey AS k, 'US' AS country, ({CODES})[n_nationkey + 1] AS state_code,
       ({STATES})[n_nationkey + 1] AS state_name,
       lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips_code, n_name AS county,
       CAST(coalesce(people, 0) AS DOUBLE) AS population,
       CAST(CAST(coalesce(people, 0) / (n_regionkey + 1) AS DECIMAL(18,2)) AS DOUBLE) AS density,
       CASE WHEN n_nationkey % 3 <> 0
            THEN '{{"w": ' || CAST(n_nationkey AS VARCHAR) || '}}' END AS county_weights,
       CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS military,
       CAST(CAST(n_nationkey / 4 AS DECIMAL(18,2)) AS DOUBLE) AS latitude,
       -(n_nationkey + 0.5) :: DOUBLE AS longitude
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY c_nationkey)
     ON c_nationkey = n_nationkey""",
    "places_rows": f"""
SELECT *, {uuid5(LOCATION_TEXT + " || CAST(k + 10000 AS VARCHAR)")} AS id FROM places_first""",
    "calendar_parts": """
SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month,
       day(o_orderdate) AS day FROM orders
UNION ALL SELECT year(o_orderdate), 5, NULL, NULL FROM orders
UNION ALL SELECT year(o_orderdate), NULL, 13, NULL FROM orders
UNION ALL SELECT year(o_orderdate), NULL, 2, 30 FROM orders
UNION ALL SELECT year(o_orderdate), quarter(o_orderdate), NULL, NULL FROM orders
UNION ALL SELECT year(o_orderdate), NULL, NULL, 32 FROM orders""",
    "calendar_rows": f"""
SELECT DISTINCT {uuid5(TIME_TEXT)} AS id, CAST(year AS SMALLINT) AS year,
       CAST({within("quarter", 1, 4)} AS SMALLINT) AS quarter,
       CAST({within("month", 1, 12)} AS SMALLINT) AS month,
       CAST({within("day", 1, 31)} AS SMALLINT) AS day,
       {floor_of("year", within("quarter", 1, 4), within("month", 1, 12), within("day", 1, 31))}
           AS date_floor
FROM calendar_parts""",
    "suppliers_linked": f"""
SELECT *, {uuid5(LOCATION_TEXT)} AS location_id, {uuid5(TIME_TEXT)} AS time_id
FROM (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS fips_code, n_name AS county,
             CAST(1995 + s_suppkey % 7 AS SMALLINT) AS year, CAST({money("s_acctbal")} AS DOUBLE)
                 AS acct_balance, s_suppkey AS supplier_key, NULL :: VARCHAR AS country,
             NULL :: VARCHAR AS state_code, NULL :: INTEGER AS quarter, NULL :: INTEGER AS month,
             NULL :: INTEGER AS day
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "suppliers_keyed": f"""
SELECT *, {uuid5("'location_id=' || location_id || '|time_id=' || time_id")} AS id,
       row_number() OVER (PARTITION BY location_id, time_id ORDER BY supplier_key) AS rn
FROM suppliers_linked""",
    "suppliers_by_key": f"""
SELECT *, {uuid5("'supplier_key=' || CAST(supplier_key AS VARCHAR)")} AS supplier_id FROM suppliers_linked""",
    "orders_tall": """
SELECT id, location_id, time_id, 'orders' AS source_name, unnest(['order_key', 'priority',
       'region_name', 'status', 'total_price']) AS metric_name,
       unnest([CAST(order_key AS DOUBLE), NULL, NULL, NULL, total_price]) AS metric_value
FROM orders_linked""",
}


def with_steps(body: str) -> str:
    """A query with the steps it needs in front, directly or through others."""
    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in STEPS.items():
            if name in text and name not in names:
                names.add(name)
                todo.append(sql)
    used = [f"{n} AS ({STEPS[n].strip()})" for n in STEPS if n in names]
    return f"WITH {', '.join(used)}\n{body.strip()}" if used else body.strip()
