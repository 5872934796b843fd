"""Star view, averages by place and period, counts, integrity and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION_COLUMNS = ("state_code", "state_name", "county", "fips_code")
TIME_COLUMNS = ("year", "quarter", "month")


def star_view(
    fact: DataFrame,
    location: DataFrame,
    time: DataFrame,
    location_columns: Sequence[str] = LOCATION_COLUMNS,
    time_columns: Sequence[str] = TIME_COLUMNS,
) -> DataFrame:
    """Facts with the attributes of their place and period, nulls where unlinked."""
    places = location.select(F.col("id").alias("location_id"), *location_columns)
    periods = time.select(F.col("id").alias("time_id"), *time_columns)
    return fact.join(places, "location_id", "left").join(periods, "time_id", "left")


def _partial_mean(tall: DataFrame, key: str) -> DataFrame:
    """Sum and count per dimension key and metric, before any join.

    The dimension is then joined to one row per key instead of one per
    observation, and a key with a third of the data costs no more than others.
    """
    return (
        tall.filter(F.col("metric_value").isNotNull() & F.col(key).isNotNull())
        .groupBy(key, "metric_name")
        .agg(F.sum("metric_value").alias("_sum"), F.count("metric_value").alias("_n"))
    )


def _mean() -> Column:
    return (F.sum("_sum") / F.sum("_n")).alias("avg_value")


def stored_sums(partials: DataFrame, key: str) -> DataFrame:
    """Sum and count per dimension key and metric, from what was added up when runs were loaded."""
    rows = partials.filter((F.col("axis") == key) & (F.col("n") > 0) & F.col("key").isNotNull())
    return rows.groupBy(F.col("key").alias(key), "metric_name").agg(F.sum("total").alias("_sum"), F.sum("n").alias("_n"))


def avg_by_state(tall: DataFrame, location: DataFrame) -> DataFrame:
    """Mean of every metric by upper-cased state code; empty values are left out."""
    return state_means(_partial_mean(tall, "location_id"), location)


def state_means(sums: DataFrame, location: DataFrame) -> DataFrame:
    """The same from sums per place."""
    states = location.filter(F.length("state_code") > 0).select(
        F.col("id").alias("location_id"), F.upper("state_code").alias("state_code")
    )
    return (
        sums.join(states, "location_id")
        .groupBy("state_code", "metric_name")
        .agg(_mean(), F.sum("_n").alias("n"))
    )


def value_domain(averages: DataFrame) -> DataFrame:
    """Lowest and highest average of each metric."""
    return averages.groupBy("metric_name").agg(
        F.min("avg_value").alias("min_value"), F.max("avg_value").alias("max_value")
    )


def avg_by_period(tall: DataFrame, time: DataFrame) -> DataFrame:
    """Mean of every metric by period, in calendar order."""
    return period_means(_partial_mean(tall, "time_id"), time)


def period_means(sums: DataFrame, time: DataFrame) -> DataFrame:
    """The same from sums per period."""
    periods = time.select(F.col("id").alias("time_id"), "year", "quarter", "month", "day", "date_floor")
    return (
        sums.withColumn("avg_value", F.col("_sum") / F.col("_n"))
        .withColumnRenamed("_n", "n")
        .drop("_sum")
        .join(periods, "time_id")
        .orderBy("date_floor", "time_id", "metric_name")
    )


def avg_by(star: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Mean of a value of the star view by any of its attributes."""
    return star.groupBy(*keys).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))


def overview(tall: DataFrame) -> DataFrame:
    """Observations, sources, known places, metrics.

    One pre-aggregation to the few (source, place, metric) combinations; the
    distinct counts run over those.
    """
    combos = tall.groupBy("source_name", "location_id", "metric_name").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return combos.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("observations"),
        F.count_distinct("source_name").alias("sources"),
        F.count_distinct("location_id").alias("locations"),
        F.count_distinct("metric_name").alias("metrics"),
    )


def stored_overview(partials: DataFrame) -> DataFrame:
    """The overview from partial sums: every observation counts once under its place."""
    rows = partials.filter(F.col("axis") == "location_id")
    return rows.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("observations"),
        F.count_distinct("source_name").alias("sources"),
        F.count_distinct("key").alias("locations"),
        F.count_distinct("metric_name").alias("metrics"),
    )


def bitmap_overview(bitmaps: DataFrame) -> DataFrame:
    """The overview from sets of numbered keys: sets of runs are united, bits counted. No
    key is looked at, and the work is one row for each run, axis and 32,768 keys."""
    united = bitmaps.groupBy("axis", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))

    def counted(axis: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("axis") == axis, F.bitmap_count("bits"))), F.lit(0))

    return united.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        counted("source_name").alias("sources"),
        counted("location_id").alias("locations"),
        counted("metric_name").alias("metrics"),
    )


def metric_ranges(partials: DataFrame) -> DataFrame:
    """Lowest and highest single value, and count, of each metric."""
    rows = partials.filter((F.col("axis") == "location_id") & (F.col("n") > 0))
    return rows.groupBy("metric_name").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")
    )


def metric_names(tall: DataFrame) -> DataFrame:
    return tall.select("metric_name").distinct().orderBy("metric_name")


def run_summary(raw: DataFrame, fact: DataFrame) -> DataFrame:
    """Per source and run: rows read, facts inserted, rows that gave no fact."""
    keys = ["source_name", "ingest_run_id"]
    read = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_read"))
    inserted = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("inserted"))
    count = F.coalesce(F.col("inserted"), F.lit(0))
    return read.join(inserted, keys, "left").select(
        *keys,
        "rows_read",
        count.alias("inserted"),
        (F.col("rows_read") - count).alias("not_inserted"),
    )


def fields_per_source(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source_name").agg(F.count(F.lit(1)).alias("fields"))


def join_sources(
    a: DataFrame,
    b: DataFrame,
    metric_a: str,
    metric_b: str,
    keys: Sequence[str] = ("fips_code", "year"),
) -> DataFrame:
    """A metric of one exported source beside one of another, per place and year.

    Each source is reduced to its mean per place and year before they meet, so
    a place with many rows in both never yields all their pairs.
    """

    def mean(df: DataFrame, metric: str, count: str) -> DataFrame:
        return (
            df.filter(F.col(metric).isNotNull())
            .groupBy(*keys)
            .agg(F.avg(metric).alias(f"avg_{metric}"), F.count(metric).alias(count))
        )

    return mean(a, metric_a, "n_a").join(mean(b, metric_b, "n_b"), list(keys))


def with_raw(fact: DataFrame, raw: DataFrame) -> DataFrame:
    """Facts with the raw row each one came from."""
    keys = ["ingest_run_id", "raw_import_id"]
    return fact.join(raw.select(*keys, "source_file", "raw_data"), keys, "left")


def orphaned_raw(raw: DataFrame, fact: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Raw rows older than some days that no fact refers to."""
    keys = ["ingest_run_id", "raw_import_id"]
    old = raw.filter(F.col("imported_at") < now - F.make_dt_interval(F.lit(days)))
    return old.join(fact.select(*keys), keys, "left_anti")


def _copies() -> Column:
    return F.count(F.lit(1)).alias("n")


def _repeated() -> Column:
    return F.count_if(F.col("n") > 1)


def _total(key: str) -> Column:
    return F.coalesce(F.sum(key), F.lit(0))


def _as_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One aggregate over everything, its columns as rows."""
    one = df.agg(*[c.alias(name) for name, c in checks.items()])
    pairs = [F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks]
    return one.select(F.inline(F.array(*pairs)))


def check_integrity(
    fact: DataFrame, location: DataFrame, time: DataFrame, raw: DataFrame
) -> DataFrame:
    """Violations per check: links without a parent, repeated keys, impossible periods.

    One aggregate for each table; its results become rows afterwards.
    """
    keys = {"location_id": location, "time_id": time}
    rows = fact.select("id", "raw_import_id", "ingest_run_id", *keys)
    for key, parent in keys.items():
        known = parent.select(F.col("id").alias(key)).distinct().withColumn(f"_{key}", F.lit(1))
        rows = rows.join(known, key, "left")
    lineage = ["ingest_run_id", "raw_import_id"]
    rows = rows.join(raw.select(*lineage).distinct().withColumn("_raw_import_id", F.lit(1)), lineage, "left")

    def lost(key: str) -> Column:
        return F.count_if(F.col(key).isNotNull() & F.col(f"_{key}").isNull()).alias(key)

    facts = rows.groupBy("id").agg(_copies(), *[lost(k) for k in (*keys, "raw_import_id")])
    out = _as_rows(facts, {
        "fact_without_location": _total("location_id"),
        "fact_without_time": _total("time_id"),
        "fact_without_raw": _total("raw_import_id"),
        "repeated_fact_id": _repeated(),
    })
    return out.unionByName(dimension_checks(location, time))


def dimension_checks(location: DataFrame, time: DataFrame) -> DataFrame:
    """Repeated keys of both dimensions, and periods that cannot be."""
    bad_time = (
        F.col("year").isNull()
        | ~F.col("quarter").between(1, 4)
        | ~F.col("month").between(1, 12)
        | ~F.col("day").between(1, 31)
    )
    places = _as_rows(location.groupBy("id").agg(_copies()), {"repeated_location_id": _repeated()})
    periods = _as_rows(
        time.groupBy("id").agg(_copies(), F.count_if(bad_time).alias("bad")),
        {"repeated_time_id": _repeated(), "impossible_period": _total("bad")},
    )
    return places.unionByName(periods)
