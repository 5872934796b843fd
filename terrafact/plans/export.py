"""Flat, typed form of a source's facts, and writing it by year."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafact.operators.analytics import LOCATION_COLUMNS, TIME_COLUMNS, star_view
from terrafact.operators.payload import parsed
from terrafact.operators.runtables import value_texts
from terrafact.types import DIMENSION_FIELDS, KIND_TYPES, TYPES


def export_frame(
    fact: DataFrame,
    location: DataFrame,
    time: DataFrame,
    schema: Mapping[str, str],
    strict_types: bool = False,
) -> DataFrame:
    """Facts joined to their place and period, payload fields as typed columns.

    Facts may come with their payload as JSON text or, from ``fact_values``, as a variant. Some type names leave their column as text; ``strict_types`` casts all.
    """
    names = sorted(n for n in schema if n not in DIMENSION_FIELDS)
    texts = value_texts(names) if "payload" in fact.columns else parsed(names)
    flat = fact.select("source_name", "ingest_run_id", "location_id", "time_id", texts.alias("_p"))
    star = star_view(flat, location, time)

    def cast(name: str):
        declared = TYPES[schema[name]]
        target = KIND_TYPES[declared.kind].simpleString() if strict_types else declared.export
        value = F.col("_p")[name]
        return (value if target in (None, "string") else value.try_cast(target)).alias(name)

    # Where a payload field has the name of a dimension column, the latter stays.
    fixed = ("source_name", "ingest_run_id", *LOCATION_COLUMNS, *TIME_COLUMNS)
    return star.select(*fixed, *[cast(n) for n in names if n not in fixed])


def _run_files(spark, path: str, runs: Iterable[str]) -> dict[str, frozenset[str]]:
    """Folders of the given runs under an export, with the files they hold."""
    jvm = spark._jvm.org.apache.hadoop.fs
    base = jvm.Path(path)
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(base):
        return {}
    out, wanted = {}, {f"ingest_run_id={run}" for run in runs}
    for year in fs.listStatus(base):
        for run in fs.listStatus(year.getPath()) if year.isDirectory() else ():
            if run.getPath().getName() in wanted:
                out[run.getPath().toString()] = frozenset(f.getPath().getName() for f in fs.listStatus(run.getPath()))
    return out


def write_export(df: DataFrame, path: str, runs: Sequence[str] | None = None) -> None:
    """Write by year and run; exporting a run again replaces all of that run.

    Years in which a run has no rows any more are removed after the write.
    ``runs`` names the runs, where a run may have become empty; else they are
    those of the rows. The rebalance hint lets Spark split a year that holds
    much of the data and merge small ones, so that files come out of even size.
    """
    spark = df.sparkSession
    if runs is None:
        runs = [r[0] for r in df.select("ingest_run_id").distinct().collect()]
    before = _run_files(spark, path, runs)
    (
        df.hint("rebalance", F.col("year"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "ingest_run_id")
        .parquet(path)
    )
    after = _run_files(spark, path, runs)
    for folder, files in before.items():
        if after.get(folder) == files:  # a folder that was written has new files
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def read_export(spark, path: str, schema) -> DataFrame:
    """An exported source; filters on ``year`` prune folders."""
    return spark.read.schema(schema).parquet(path)
