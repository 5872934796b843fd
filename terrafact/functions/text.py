"""Small text helpers shared by the other expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_to_null(c: Column) -> Column:
    """Strip white space on both ends; nothing left means null.

    Most texts begin and end with a visible ASCII character and stay as they are; only the others
    are looked through for white space, which is dear. Texts compare by their bytes.
    """
    last = F.substring(c, -1, 1)
    plain = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(plain, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit("")))


def utc_text(c: Column) -> Column:
    """RFC 3339 text of a timestamp in UTC, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch).cast("string")
    whole = F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))


def finite(c: Column) -> Column:
    """The double value of a float, null where it is not a finite number."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
