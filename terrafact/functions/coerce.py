"""Text to typed value. Every function returns null for text it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafact.types import DATE_FORMATS, KIND_TYPES, TIMESTAMP_FORMATS

# Accepted texts and patterns.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")
SIGNED = r"^[+-]?[0-9]+$"
UNSIGNED = r"^\+?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY = r"(?i)^[+-]?(inf|infinity)$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"
# Numbers that may be beyond a double, and halves of a surrogate pair by themselves.
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
LARGE = r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{300}|[0-9]{9}[eE]\+?[0-9]{2}"
LONE_HIGH = r"(?<!\\)(?:\\\\)*+\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
LONE_LOW = r"(?<!\\)(?:\\\\)*+(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
ZONES = {
    "UT|GMT|Z": "+0000",
    "EDT": "-0400",
    "EST|CDT": "-0500",
    "CST|MDT": "-0600",
    "MST|PDT": "-0700",
    "PST": "-0800",
}
# Seconds since the epoch of the first and last instant a timestamp may have.
FIRST_SECOND = -8_334_601_228_800
LAST_SECOND = 8_210_266_876_799

SIGNED_SQL = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint"}
UNSIGNED_MAX = {"u8": 2**8 - 1, "u16": 2**16 - 1, "u32": 2**32 - 1, "u64": 2**64 - 1}

# Month names, in full or by three letters; one of twelve groups holds the letters.
_MONTH = "(?i:" + "|".join(f"({m[:3]})(?:{m[3:]})?" for m in MONTHS) + ")"
# Possessive digits: a part takes all it can and gives nothing back.
_D, _Y = r"\s*([0-9]{1,2}+)", r"\s*([0-9]{1,4}+)"
DATE_PATTERNS = {
    "iso8601": (f"^{_Y}-{_D}-{_D}$", "000$1-$2-$3"),
    "month_day_year": (f"^{_D}/{_D}/{_Y}$", "000$3-$1-$2"),
    "day_month_year": (f"^{_D}/{_D}/{_Y}$", "000$3-$2-$1"),
    "year_month_day": (f"^{_Y}{_D}{_D}$", "000$1-$2-$3"),
}
LONG_US = rf"^{_MONTH}\s*([0-9]{{1,2}}),\s*([0-9]{{1,4}})$"
LONG_US_PARTS = "".join(f"${i}" for i in range(1, 13)) + " $13 $14"
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
)
RFC2822 = (
    r"^(?:((?i:sun|mon|tue|wed|thu|fri|sat))\s*,)?\s*([0-9]{1,2})\s+"
    r"((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))\s+([0-9]{2,4})\s+"
    r"([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?\s+([+-][0-9]{4}|[A-Za-z]+)$"
)
US_DATETIME = (
    r"^([0-9]{1,2})/\s*([0-9]{1,2})/\s*([0-9]{1,4}+)\s*"
    r"([0-9]{1,2}):\s*([0-9]{1,2}):\s*([0-9]{1,2})$"
)


def signed_int(c: Column, kind: str) -> Column:
    return F.when(c.rlike(SIGNED), c.try_cast(SIGNED_SQL[kind]))


def unsigned_int(c: Column, kind: str) -> Column:
    wide = F.when(c.rlike(UNSIGNED), c.try_cast("decimal(20,0)"))
    limit = F.lit(str(UNSIGNED_MAX[kind])).cast("decimal(20,0)")
    return F.when(wide <= limit, wide).cast(KIND_TYPES[kind])


def floating(c: Column, kind: str) -> Column:
    spark_type = KIND_TYPES[kind]
    return F.when(c.rlike(DECIMAL) | c.rlike(INFINITY), c.try_cast(spark_type)).when(
        c.rlike(NOT_A_NUMBER), F.lit(float("nan")).cast(spark_type)
    )


def boolean(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def json_text(c: Column) -> Column:
    """The text itself where it is one whole JSON value.

    The parser ignores what follows the first value, so the text is tried as
    an array element and as an object member: what could slip through after a
    complete value differs between the two.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    # Strings are blanked before numbers are looked at.
    plain = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', '""')
    huge = F.exists(
        F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)),
        lambda n: F.abs(n.cast("double")) == F.lit(float("inf")),
    )
    too_large = plain.rlike(LARGE) & huge
    alone = c.rlike(LONE_HIGH) | c.rlike(LONE_LOW)
    return F.when(as_element.isNotNull() & as_member.isNotNull() & ~too_large & ~alone, c)


def date(c: Column, fmt: str | None = None) -> Column:
    fmt = fmt or DATE_FORMATS[0]
    if fmt == "long_us":
        text = F.regexp_replace(c, LONG_US, LONG_US_PARTS)
        return F.when(c.rlike(LONG_US), F.try_to_date(text, "MMM d y"))
    pattern, order = DATE_PATTERNS[fmt]
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, order).try_cast("date"))


def _rfc2822(c: Column) -> Column:
    form = F.lit("d MMM yyyy HH:mm:ss Z")
    text = F.regexp_replace(c, RFC2822, "$2 $3 $4 $5:$6:$7 $8")
    # Zone names, left-out seconds and short years are rare: only text that
    # does not read in its full form is rewritten.
    full = F.replace(text, F.lit(": "), F.lit(":00 "))
    for names, offset in ZONES.items():
        full = F.regexp_replace(full, f"(?i) (?:{names})$", f" {offset}")
    # Two digits up to 49 lie in this century, other short years in the last one.
    full = F.regexp_replace(full, "^(\\S+ \\S+) 1?([0-4][0-9]) ", "$1 20$2 ")
    full = F.regexp_replace(full, "^(\\S+ \\S+) 0?([0-9]{2}) ", "$1 19$2 ")
    instant = F.coalesce(F.try_to_timestamp(text, form), F.try_to_timestamp(full, form))
    # A weekday, where there is one, has to be that of the date.
    day = F.coalesce(
        *[F.try_to_date(F.substring_index(t, " ", 3), "d MMM yyyy") for t in (text, full)]
    )
    weekday = F.lower(F.substring(c, 1, 3))
    right_day = c.rlike("^[0-9]") | (weekday == F.lower(F.date_format(day, "EEE")))
    return F.when(c.rlike(RFC2822) & right_day, instant)


def timestamp(c: Column, fmt: str | None = None) -> Column:
    fmt = fmt or TIMESTAMP_FORMATS[0]
    if fmt == "rfc3339":
        return F.when(c.rlike(RFC3339), F.upper(c).try_cast("timestamp"))
    if fmt == "rfc2822":
        return _rfc2822(c)
    if fmt in ("unix_seconds", "unix_millis"):
        n = signed_int(c, "i64")
        if fmt == "unix_seconds":
            return F.timestamp_seconds(F.when(n.between(FIRST_SECOND, LAST_SECOND), n))
        in_range = n.between(FIRST_SECOND * 1000, LAST_SECOND * 1000 + 999)
        return F.timestamp_millis(F.when(in_range, n))
    if fmt == "us_datetime":
        # A timestamp's year is read with four to six digits.
        text, short = (
            F.regexp_replace(c, US_DATETIME, f"{zeros}$3-$1-$2 $4:$5:$6Z") for zeros in ("00", "000")
        )
        instant = F.coalesce(text.try_cast("timestamp"), short.try_cast("timestamp"))
        return F.when(c.rlike(US_DATETIME), instant)
    raise ValueError(f"unknown timestamp format: {fmt!r}")


def coerce(c: Column, kind: str, fmt: str | None = None) -> Column:
    """Read text as a value of ``kind``."""
    if kind in SIGNED_SQL:
        return signed_int(c, kind)
    if kind in UNSIGNED_MAX:
        return unsigned_int(c, kind)
    if kind in ("f32", "f64"):
        return floating(c, kind)
    if kind == "bool":
        return boolean(c)
    if kind == "json":
        return json_text(c)
    if kind == "date":
        return date(c, fmt)
    if kind == "timestamp":
        return timestamp(c, fmt)
    raise ValueError(f"nothing to coerce for kind {kind!r}")
