"""First-wins, last-wins, insert-ignore and upsert, shared by facts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numbers(df: DataFrame, order: str) -> list[str] | None:
    """The whole numbers that the order consists of: one, or an int and another."""
    kind = df.schema[order].dataType
    small = (T.ByteType, T.ShortType, T.IntegerType)
    whole = (*small, T.LongType)
    if isinstance(kind, whole):
        return [order]
    if isinstance(kind, T.StructType) and len(kind) == 2:
        if isinstance(kind[0].dataType, small) and isinstance(kind[1].dataType, whole):
            return [f"{order}.{f.name}" for f in kind]
    return None


def _rank(df: DataFrame, order: str, rest: Sequence[str]) -> Column | None:
    """The order as one number where it is a whole number or an int and a whole number: numbers are
    folded in place by a hash aggregate. Its last digits are a hash of the row, which breaks ties."""
    kind = df.schema[order].dataType
    small = (T.ByteType, T.ShortType, T.IntegerType)
    whole = (*small, T.LongType)
    row = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")

    def digits(n: int) -> Column:
        return F.lit(Decimal(10) ** n)

    def number(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    if isinstance(kind, whole):
        return (number(F.col(order)) * digits(18) + F.pmod(row, F.lit(10**18))).cast("decimal(38,0)")
    if isinstance(kind, T.StructType) and len(kind) == 2:
        (high, low), types = (F.col(f"{order}.{f.name}") for f in kind), [f.dataType for f in kind]
        if isinstance(types[0], small) and isinstance(types[1], whole):
            both = (number(high) * digits(19) * F.lit(2) + number(low)).cast("decimal(29,0)")
            return (both * digits(8) + F.pmod(row, F.lit(10**8))).cast("decimal(38,0)")
    return None


def _one_per_key(df: DataFrame, key: str, order: str, pick) -> DataFrame:
    # Aggregates, not a window: each task folds its copies of a key into one
    # before the shuffle, so a key that holds much of the data stays cheap.
    df = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    rest = [c for c in df.columns if c not in (key, order)]
    rank = _rank(df, order, rest)
    if rank is None:
        # One pass over rows that may be dear to make; the other columns break ties.
        best = df.groupBy(key).agg(pick(F.struct(order, *rest)).alias("_best"))
        return best.select(*[F.col(c if c == key else f"_best.{c}") for c in df.columns])
    # Only keys and ranks take part; whole rows are then looked up by both, and of
    # equal rows one is left where they already lie.
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy(key).agg(pick("_rank").alias("_rank"))
    return ranked.join(best, [key, "_rank"], "left_semi").distinct().select(*df.columns)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of every key: that with the lowest ``order``. Of rows that tie the other columns
    decide which, whatever the order of rows; rows without a key go."""
    return _one_per_key(df, key, order, F.min)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of every key: that with the highest ``order``; ties and missing keys as above."""
    return _one_per_key(df, key, order, F.max)


def first_by_sort(df: DataFrame, key: str, order: str) -> DataFrame:
    """The same rows as ``first_per_key``, for frames whose rows are dear to make and whose keys mostly come
    once: rows are made, dealt and sorted once, where the aggregate makes and deals them twice.

    Spark limits each task to one row of a key before the shuffle, so that a key that holds much of
    the data is no load for the task that gets it.
    """
    numbers = _numbers(df, order)
    if numbers is None:
        return first_per_key(df, key, order)
    df = df.filter(F.col(key).isNotNull() & reduce(Column.__and__, [F.col(n).isNotNull() for n in numbers]))
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")
    ties = F.pmod(row, F.lit(10**18 if len(numbers) == 1 else 10**8))  # as in _rank
    place = F.row_number().over(Window.partitionBy(key).orderBy(*numbers, ties))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).select(*df.columns)


def folded(df: DataFrame, order: str) -> DataFrame:
    """Rows that differ in their order alone as one, with its lowest: a hash aggregate for frames that
    say the same few things many times. ``first_per_key`` finds the same rows in it."""
    numbers = _numbers(df, order)
    if numbers is None:
        return df
    rest = [c for c in df.columns if c != order]
    if len(numbers) == 1:
        return df.groupBy(*rest).agg(F.min(order).alias(order)).select(*df.columns)
    high, low = (f.name for f in df.schema[order].dataType)
    parts = df.filter(F.col(order).isNotNull()).select(*rest, F.col(numbers[0]).alias("_high"), F.col(numbers[1]).alias("_low"))
    best = parts.groupBy(*rest, "_high").agg(F.min("_low").alias("_low"))
    return best.withColumn(order, F.struct(F.col("_high").alias(high), F.col("_low").alias(low))).select(*df.columns)


def without_conflicts(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key ``existing`` does not have.

    The keys in conflict are found first, from the large table's side: with a
    new batch small enough to broadcast, the existing keys are only scanned,
    never shuffled. An anti join straight against the existing table could not
    broadcast the batch.
    """
    in_conflict = existing.select(key).join(new.select(key), key, "left_semi")
    return new.join(in_conflict, key, "left_anti")


def upsert(
    new: DataFrame,
    existing: DataFrame,
    merge: str = "replace",
    key: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the new row where there is one, else the existing row.

    Both sides hold a key at most once. ``replace`` takes new rows whole, nulls
    included; ``coalesce`` fills their nulls from the existing row. Columns in
    ``keep`` stay as they were for keys that exist.
    """
    if merge not in ("replace", "coalesce"):
        raise ValueError(f"merge must be 'replace' or 'coalesce', not {merge!r}")
    columns = existing.columns
    new = new.select(*columns)
    if merge == "replace" and not keep:
        return existing.join(new.select(key), key, "left_anti").select(*columns).unionByName(new)
    old, fresh = existing.alias("old"), new.alias("fresh")
    is_new = F.col(f"fresh.{key}").isNotNull()

    def value(c: str):
        a, b = F.col(f"fresh.{c}"), F.col(f"old.{c}")
        if c == key or merge == "coalesce" and c not in keep:
            return F.coalesce(a, b).alias(c)
        if c in keep:
            return F.coalesce(b, a).alias(c)
        return F.when(is_new, a).otherwise(b).alias(c)

    joined = old.join(fresh, F.col(f"old.{key}") == F.col(f"fresh.{key}"), "full_outer")
    return joined.select(*[value(c) for c in columns])
