"""The tables of one warehouse folder, as plain Parquet.

Facts and raw rows are partitioned by source and run: a load adds run folders,
a rollback removes them. Dimensions and the field registry are small and
rewritten as numbered snapshots; the newest one Spark has marked complete is
the current one, so readers never see half a snapshot. Beside the facts stand tables
derived from them (``derived``). A warehouse has one writer at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafact import types as S
from terrafact.operators.runtables import RUN_DERIVED
from terrafact.sources.derived import Derived

RUN_TABLES = {"normalized_imports": S.FACT_SCHEMA, "raw_imports": S.RAW_SCHEMA}
SNAPSHOT_TABLES = {
    "dim_location": S.LOCATION_SCHEMA,
    "dim_time": S.TIME_SCHEMA,
    "import_schema": S.FIELD_REGISTRY_SCHEMA,
}
LOG_TABLES = {
    "run_log": S.RUN_LOG_SCHEMA,
    "dim_file_log": S.DIM_LOG_SCHEMA,
    "import_sources": S.SOURCE_REGISTRY_SCHEMA,
}
RUN_PARTITION = ("source_name", "ingest_run_id")

# Point reads by these columns skip the row groups their filters rule out.
LOOKED_UP = ("id", "location_id", "time_id")


def configure(spark: SparkSession) -> None:
    """Session settings the expressions rely on."""
    # JSON objects may repeat a key; the last one counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The JVM does not compile methods above 8000 bytes. Sources with many
    # fields make larger ones, which then run interpreted; with this limit
    # Spark splits them into methods that are compiled.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="terrafact-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, id_buckets: int | None = None):
        """``id_buckets``: buckets of the id index when it is first made; as many as shuffle
        partitions unless given."""
        configure(spark)
        self.spark = spark
        self.path = path.rstrip("/")
        self.derived = Derived(self, RUN_DERIVED, id_buckets)

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]

    def staging(self) -> str:
        """A new folder for the intermediate table of one load."""
        named = self.spark.conf.get("spark.checkpoint.dir", None)
        base = named.rstrip("/") if named else f"{self.path}/_staging"
        return f"{base}/load-{uuid.uuid4()}"

    # Reads

    def _snapshot(self, table: str) -> int:
        """Number of the newest complete snapshot, 0 when there is none."""
        numbers = (re.fullmatch(r"v=(\d+)", n) for n in self.folders(f"{self.path}/{table}"))
        for n in sorted((int(m[1]) for m in numbers if m), reverse=True):
            if self.exists(f"{self.path}/{table}/v={n}/_SUCCESS"):
                return n
        return 0

    def read(self, table: str) -> DataFrame:
        if table in SNAPSHOT_TABLES:
            schema, n = SNAPSHOT_TABLES[table], self._snapshot(table)
            path = f"{self.path}/{table}/v={n}" if n else None
        else:
            schema = (RUN_TABLES | LOG_TABLES)[table]
            path = f"{self.path}/{table}"
            path = path if self.exists(path) else None
        if path is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    # Writes

    def write_snapshot(self, table: str, df: DataFrame) -> None:
        names = SNAPSHOT_TABLES[table].names
        last = self._snapshot(table)
        path = f"{self.path}/{table}/v={last + 1}"
        df.select(*names).write.mode("overwrite").parquet(path)
        # The one before stays for readers that have just looked it up.
        for name in self.folders(f"{self.path}/{table}"):
            if (m := re.fullmatch(r"v=(\d+)", name)) and int(m[1]) < last:
                self.remove(f"{self.path}/{table}/{name}")

    def append_log(self, table: str, df: DataFrame) -> None:
        df.select(*LOG_TABLES[table].names).write.mode("append").parquet(f"{self.path}/{table}")

    def write_runs(self, table: str, df: DataFrame) -> None:
        """Write whole runs; a run that is there already is replaced."""
        names = RUN_TABLES[table].names
        writer = (
            df.select(*names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*RUN_PARTITION)
        )
        for column in LOOKED_UP:
            if column in names:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(
            f"{self.path}/{table}"
        )

    def runs_of(self, run_id: str, table: str = "normalized_imports") -> list[str]:
        """Folders that hold a run: one per source."""
        return [f"{self.path}/{table}/{f}" for f in self.run_folders([run_id], table)]

    def run_folders(self, run_ids: Iterable[str], table: str = "normalized_imports") -> list[str]:
        """The same for several runs, relative to the table: a listing a source."""
        wanted = {f"ingest_run_id={r}" for r in run_ids}
        base = f"{self.path}/{table}"
        sources = [s for s in self.folders(base) if s.startswith("source_name=")]
        return [f"{s}/{r}" for s in sources for r in self.folders(f"{base}/{s}") if r in wanted]

    def facts_of(self, run_ids: Iterable[str]) -> DataFrame | None:
        """Facts of the given runs; None when there are none."""
        runs = list(run_ids)
        if not self.run_folders(runs):
            return None
        return self.read("normalized_imports").filter(F.col("ingest_run_id").isin(runs))

    def remove_run(self, run_id: str, tables: Iterable[str] = tuple(RUN_TABLES)) -> None:
        """Remove what a run left in the given tables."""
        self.remove_runs([run_id], tables)

    def remove_runs(self, run_ids: Iterable[str], tables: Iterable[str] = tuple(RUN_TABLES)) -> None:
        runs = list(run_ids)
        for table in tables:
            found = self.run_folders(runs, table)
            if table == "normalized_imports" and found:
                with self.derived.changing(runs):
                    self._remove_folders(table, found)
            else:
                self._remove_folders(table, found)

    def _remove_folders(self, table: str, folders: Iterable[str]) -> None:
        for folder in folders:
            self.remove(f"{self.path}/{table}/{folder}")

    def rollback_run(self, run_id: str) -> int:
        """Delete the facts of a run and return how many there were."""
        return self.rollback_runs([run_id])

    def rollback_runs(self, run_ids: Iterable[str]) -> int:
        """Delete the facts of several runs, counted in one job; returns how many there were."""
        runs = list(run_ids)
        facts = self.facts_of(runs)
        deleted = 0 if facts is None else facts.count()
        self.remove_runs(runs, ["normalized_imports"])
        return deleted
