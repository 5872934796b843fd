"""Registries of sources and fields, the dimension load log, already-loaded checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafact.config import SourceConfig
from terrafact.operators.keep import upsert
from terrafact.types import DIM_LOG_SCHEMA, FIELD_REGISTRY_SCHEMA, SOURCE_REGISTRY_SCHEMA


class Conflict(ValueError):
    """A source name that is registered already."""


def schema_rows(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """Registry rows of a definition: one per declared or derived field."""
    rows = [(source.name, name, kind) for name, kind in sorted(source.schema.items())]
    df = spark.createDataFrame(rows, "source_name string, field_name string, field_type string")
    return stamp_schema_rows(df)


def stamp_schema_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "source_name",
        "field_name",
        "field_type",
        F.lit(None).cast("string").alias("description"),
        F.current_timestamp().alias("created_at"),
    )


def register_schema(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Registry after declaring fields: types are replaced, first dates are kept."""
    key = F.to_json(F.struct("source_name", "field_name"))
    merged = upsert(
        new.withColumn("_key", key),
        existing.withColumn("_key", key),
        key="_key",
        keep=("created_at", "description"),
    )
    return merged.select(*FIELD_REGISTRY_SCHEMA.names)


def load_schema(registry: DataFrame, source_name: str) -> dict[str, str]:
    """Field names and types of one source. As long as its definition, so collected."""
    rows = registry.filter(F.col("source_name") == F.lit(source_name)).select(
        "field_name", "field_type"
    )
    return dict(rows.collect())


def schema_of(registry: DataFrame, source_name: str) -> DataFrame:
    return registry.filter(F.col("source_name") == F.lit(source_name)).select(
        "field_name", "field_type"
    )


def new_sources(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources whose name is not registered yet."""
    return new.join(existing.select("name"), "name", "left_anti")


def source_row(spark: SparkSession, name: str, description: str | None) -> DataFrame:
    df = spark.createDataFrame([(name, description)], "name string, description string")
    return df.select(
        F.uuid().alias("id"), "name", "description", F.current_timestamp().alias("created_at")
    ).select(*SOURCE_REGISTRY_SCHEMA.names)


def log_row(spark: SparkSession, source_name: str, target: str, path: str, rows: int) -> DataFrame:
    df = spark.createDataFrame(
        [(source_name, target, path, rows)],
        "source_name string, target string, file_path string, row_count bigint",
    )
    return df.select(
        "*", F.uuid().alias("id"), F.current_timestamp().alias("persisted_at")
    ).select(*DIM_LOG_SCHEMA.names)


def run_log_rows(spark: SparkSession, source_name: str, runs: list[tuple[str, str, str]]) -> DataFrame:
    """Log rows of finished runs: (file, run, status)."""
    df = spark.createDataFrame(runs, "source_file string, ingest_run_id string, status string")
    return df.withColumns({"source_name": F.lit(source_name), "logged_at": F.current_timestamp()})


def pending_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """Listed files that the log of runs does not name, under any source."""
    loaded = log.select("source_file").distinct()
    return files.join(loaded, "source_file", "left_anti")


def pending_dim_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """Listed (source, file) pairs without a successful dimension load."""
    keys = ["source_name", "file_path"]
    return files.join(log.select(*keys).distinct(), keys, "left_anti")
