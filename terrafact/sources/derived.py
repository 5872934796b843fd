"""Tables kept beside the facts and always derived from them.

Two kinds. The id index says which ids are stored, by hash bucket, so that a load looks for
conflicts only in the buckets that it touches. Run tables hold something of each run
(parsed payloads, postings, partial sums) in a folder of its own, as the facts do.

Whatever changes the facts of some runs does so inside ``changing``: a log row announces
the change, the facts change, all that is derived from these runs is made again from the
facts as they are then, and a second row closes the change. A change that never closed, as
its driver was lost, is made good by the next one. So nothing derived has to be trusted
beyond its log, and a run that is replayed or rolled back needs no case of its own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from terrafact.sources.warehouse import Warehouse

FACTS = "normalized_imports"
LOG_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("load", "ingest_run_id", "state")]
    + [T.StructField("logged_at", T.TimestampType())]
)
BEGUN, LIVE, DEAD = "begun", "live", "dead"


class IdIndex:
    """Ids of all facts, by bucket.

    A Parquet table partitioned by bucket and bucketed by the same hash in Spark's sense:
    a filter on the bucket skips folders, and a join on the id needs no exchange on this
    side, however large the batch. Rows name the load that wrote them. A run that is
    written again or rolled back leaves its old rows dead, by the log, until ``rebuild``.
    """

    def __init__(self, wh: Warehouse, buckets: int | None = None):
        self.wh, self._wanted = wh, buckets

    # Generations: a rebuilt index takes the place of the one before once its log is there.

    def _generations(self) -> list[tuple[int, int, str]]:
        base = f"{self.wh.path}/fact_ids"
        names = ((re.fullmatch(r"g(\d+)-b(\d+)", n), n) for n in self.wh.folders(base))
        return sorted(((int(m[1]), int(m[2]), f"{base}/{n}") for m, n in names if m), reverse=True)

    def _current(self) -> tuple[str, int] | None:
        """Folder and number of buckets of the newest complete generation."""
        for _, buckets, path in self._generations():
            if self.wh.exists(f"{path}/log/_SUCCESS"):
                return path, buckets
        return None

    @property
    def exists(self) -> bool:
        return self._current() is not None

    @property
    def buckets(self) -> int:
        return self._current()[1]

    def _table(self, path: str, buckets: int) -> str:
        """The folder as a table of the session; its buckets are known to Spark through it only."""
        spark = self.wh.spark
        name, place = _name(path), f"{path}/ids".replace("\\", "\\\\").replace("'", "\\'")
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (id STRING, ingest_run_id STRING, load STRING, bucket INT) USING parquet "
                f"PARTITIONED BY (bucket) CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{place}'"
            )
            self._look(name, path)
        return name

    def _look(self, name: str, path: str) -> None:
        if self.wh.exists(f"{path}/ids"):
            self.wh.spark.catalog.recoverPartitions(name)
            self.wh.spark.catalog.refreshTable(name)

    def refresh(self) -> None:
        """Look again at what other sessions wrote."""
        path, buckets = self._current()
        self._look(self._table(path, buckets), path)

    def _append(self, path: str, buckets: int, ids: DataFrame, load: str) -> None:
        name = self._table(path, buckets)
        rows = ids.select("id", "ingest_run_id", F.lit(load).alias("load"), bucket_of("id", buckets).alias("bucket"))
        # One task and file a bucket: the hash that deals rows to tasks is that of the bucket.
        rows.repartition(buckets, "id").write.insertInto(name)

    def _log(self) -> DataFrame:
        return self.wh.spark.read.schema(LOG_SCHEMA).parquet(f"{self._current()[0]}/log")

    def _write_log(self, path: str, rows: DataFrame) -> None:
        rows = rows.withColumn("logged_at", F.current_timestamp()).select(*LOG_SCHEMA.names)
        rows.coalesce(1).write.mode("append").parquet(f"{path}/log")

    def _rows(self, load: str, runs: Iterable[str], state: str) -> DataFrame:
        return self.wh.spark.createDataFrame([(load, r, state) for r in runs], "load string, ingest_run_id string, state string")

    # Changes

    def rebuild(self, buckets: int | None = None) -> None:
        """The index made again from the facts: dead rows go, files are merged, the number of
        buckets may change. Readers keep the index they have until the new one is complete."""
        now = self._current()
        old = self._generations()
        n = buckets or (now[1] if now else self._wanted or int(self.wh.spark.conf.get("spark.sql.shuffle.partitions")))
        path = f"{self.wh.path}/fact_ids/g{old[0][0] + 1 if old else 1}-b{n}"
        load = str(uuid.uuid4())
        facts = self.wh.read(FACTS)
        self._append(path, n, facts, load)
        runs = facts.select("ingest_run_id").distinct()
        self._write_log(path, runs.select(F.lit(load).alias("load"), "ingest_run_id", F.lit(LIVE).alias("state")))
        for _, _, folder in old:
            self.wh.spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")
            self.wh.remove(folder)

    def unfinished(self) -> list[str]:
        """Runs of changes that were announced and never closed."""
        log = self._log()
        closed = log.filter(F.col("state") != BEGUN).select("load", "ingest_run_id")
        return sorted({r[0] for r in log.filter(F.col("state") == BEGUN).join(closed, ["load", "ingest_run_id"], "left_anti").select("ingest_run_id").collect()})

    def begin(self, runs: list[str]) -> str:
        load = str(uuid.uuid4())
        self._write_log(self._current()[0], self._rows(load, runs, BEGUN))
        return load

    def finish(self, load: str, runs: list[str]) -> None:
        """Index what the facts of the runs are now; what was indexed for them before is dead."""
        path, buckets = self._current()
        facts = self.wh.facts_of(runs)
        if facts is not None:
            self._append(path, buckets, facts, load)
        log = self._log().filter(F.col("ingest_run_id").isin(runs) & (F.col("load") != load))
        dead = log.filter(F.col("state") == DEAD).select("load", "ingest_run_id")
        before = log.join(dead, ["load", "ingest_run_id"], "left_anti").select("load", "ingest_run_id").distinct()
        rows = before.select("load", "ingest_run_id", F.lit(DEAD).alias("state"))
        self._write_log(path, rows.unionByName(self._rows(load, runs, LIVE)))

    # Reads

    def live(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """id, ingest_run_id, bucket of all stored facts, or of those in some buckets."""
        path, _ = self._current()
        rows = self.wh.spark.table(self._table(path, self.buckets))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(list(buckets)))
        dead = self._log().filter(F.col("state") == DEAD).select("load", "ingest_run_id")
        if not dead.isEmpty():
            # as long as the list of rolled back and replayed runs; rebuild empties it
            rows = rows.join(dead, ["load", "ingest_run_id"], "left_anti")
        return rows.select("id", "ingest_run_id", "bucket")

    def dead_stamp(self) -> str:
        """Changes whenever rows of the index die without a change of its files."""
        dead = self._log().filter(F.col("state") == DEAD)
        r = dead.agg(F.count(F.lit(1)), F.sum(F.xxhash64("load", "ingest_run_id").cast("decimal(38,0)"))).first()
        return f"{r[0]}:{r[1]}"

    def conflicts(self, ids: DataFrame, but: Iterable[str] = ()) -> DataFrame:
        """Those of the given ids that are stored, by other runs than those named."""
        found = ids.select(bucket_of("id", self.buckets).alias("b")).distinct().limit(self.buckets).collect()
        touched = sorted(r["b"] for r in found)  # numbers of buckets
        stored = self.live(touched if len(touched) < self.buckets else None)
        if but := list(but):
            stored = stored.filter(~F.col("ingest_run_id").isin(but))
        return stored.select("id").join(ids.select("id"), "id", "left_semi")


def _name(path: str) -> str:
    return f"terrafact_ids_{hashlib.md5(path.encode()).hexdigest()[:20]}"


def bucket_of(column: str, buckets: int):
    """The bucket that Spark's own bucketing gives a value."""
    return F.pmod(F.hash(column), F.lit(buckets))


NUMBER_SCHEMA = T.StructType(
    [T.StructField("axis", T.StringType()), T.StructField("key", T.StringType()), T.StructField("number", T.LongType())]
)
# Numbers are given out in so many sequences, interleaved, so that no task sees all new keys.
SEQUENCES = 64


class RunTable:
    """What ``build`` makes of facts, in a folder for each run. With ``keys``, which names the
    (axis, key) pairs of facts, ``build`` is also given a number for each of them. With ``cluster``
    the files of a run hold ranges of that column, in order, and a list says which file holds which.
    ``by_row`` says that ``build`` makes each row from one fact, so that rows of one run may be written
    where its facts are read."""

    def __init__(
        self,
        name: str,
        schema: T.StructType,
        build: Callable[..., DataFrame],
        sort: tuple[str, ...] = (),
        keys: Callable[[DataFrame], DataFrame] | None = None,
        cluster: str | None = None,
        by_row: bool = False,
    ):
        self.name, self.schema, self.build, self.sort, self.keys, self.cluster = name, schema, build, sort, keys, cluster
        self.by_row = by_row

    @property
    def folders(self) -> list[str]:
        return [self.name, f"{self.name}_files"] if self.cluster else [self.name]


FILE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file", "low", "high")]
    + [T.StructField("n", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("source_name", "ingest_run_id")]
)


class Derived:
    """The id index and the run tables of a warehouse that were asked for."""

    def __init__(self, wh: Warehouse, tables: dict[str, RunTable], buckets: int | None = None):
        self.wh, self.tables, self.ids = wh, tables, IdIndex(wh, buckets)
        self._inside = False

    def kept(self) -> list[RunTable]:
        """Run tables that this warehouse has."""
        return [t for t in self.tables.values() if self.wh.exists(f"{self.wh.path}/{t.name}/_kept")]

    def create(self, name: str) -> None:
        """Derive a run table from all facts; from now on every change keeps it up."""
        table = self.tables[name]
        self._write(table, self.wh.read(FACTS))
        self.wh.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.wh.path}/{name}/_kept"
        )

    def read(self, name: str) -> DataFrame:
        path = f"{self.wh.path}/{name}"
        if not self.wh.exists(f"{path}/_kept"):
            raise LookupError(f"{name} is not kept here: create it first")
        return self.wh.spark.read.schema(self.tables[name].schema).parquet(path)

    def numbers(self) -> DataFrame:
        """The number of every key that was met so far; a key keeps its number for good."""
        path = f"{self.wh.path}/key_numbers"
        if not self.wh.exists(path):
            return self.wh.spark.createDataFrame([], NUMBER_SCHEMA)
        return self.wh.spark.read.schema(NUMBER_SCHEMA).parquet(path)

    def _number(self, keys: DataFrame) -> DataFrame:
        """Numbers for keys that have none yet, then all numbers. Numbers are nearly dense: each sequence
        counts on where it ended, and a hash deals keys to sequences evenly."""
        known = self.numbers()
        sequence = F.pmod(F.xxhash64("axis", "key"), F.lit(SEQUENCES))
        last = known.groupBy("axis", sequence.alias("_s")).agg(F.max(F.floor(F.col("number") / SEQUENCES)).alias("_last"))
        new = keys.distinct().join(known, ["axis", "key"], "left_anti").withColumn("_s", sequence)
        place = F.row_number().over(Window.partitionBy("axis", "_s").orderBy("key"))
        after = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n") - 1
        given = new.withColumn("_n", place).join(last, ["axis", "_s"], "left")
        rows = given.select("axis", "key", (after * SEQUENCES + F.col("_s")).cast("bigint").alias("number"))
        rows.write.mode("append").parquet(f"{self.wh.path}/key_numbers")
        return self.numbers()

    def _write(self, table: RunTable, facts: DataFrame, one_run: bool = False) -> None:
        more = (self._number(table.keys(facts)),) if table.keys else ()
        run = ("source_name", "ingest_run_id")
        rows = table.build(facts, *more).select(*table.schema.names)
        if table.cluster:
            rows = rows.repartitionByRange(*run, table.cluster).sortWithinPartitions(*run, table.cluster)
        elif not (one_run and table.by_row):
            rows = rows.hint("rebalance", *map(F.col, run))
        if table.sort:
            rows = rows.sortWithinPartitions(*run, *table.sort)
        self._put(rows, table.name)
        if table.cluster:
            runs = [r[0] for r in facts.select("ingest_run_id").distinct().collect()]  # those that change
            stored = self.wh.spark.read.schema(table.schema).parquet(f"{self.wh.path}/{table.name}") if runs else None
            if stored is not None:
                files = stored.filter(F.col("ingest_run_id").isin(runs)).groupBy(F.col("_metadata.file_path").alias("file"), *run)
                key = F.col(table.cluster)
                self._put(files.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")), f"{table.name}_files")

    def _put(self, rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("source_name", "ingest_run_id").parquet(f"{self.wh.path}/{name}")

    def page(self, name: str, after: str | None, limit: int) -> DataFrame:
        """The rows behind a value of the column that a table is clustered by, in its order, at most
        ``limit``. Only files that can hold them are opened.

        Every file that ends behind ``after`` has a row there, so the first ``limit`` of them by
        their ends say where the page is over at the latest.
        """
        table = self.tables[name]
        self.read(name)
        path = f"{self.wh.path}/{name}"
        nothing = self.wh.spark.createDataFrame([], table.schema)
        if not self.wh.exists(f"{path}_files"):
            return nothing
        files = self.wh.spark.read.schema(FILE_SCHEMA).parquet(f"{path}_files")
        if after is not None:
            files = files.filter(F.col("high") > F.lit(after))
        first = files.orderBy("high", "file").limit(limit).collect()
        sure, end = 0, None
        for f in first:
            sure += f["n"] if after is None or f["low"] > after else 1
            if sure >= limit:
                end = f["high"]
                break
        if end is not None:
            files = files.filter(F.col("low") <= F.lit(end))
        elif len(first) < limit:  # these are all
            files = None
        wanted = [unquote(r["file"]) for r in (first if files is None else files.select("file").collect())]
        if not wanted:
            return nothing
        rows = self.wh.spark.read.schema(table.schema).option("basePath", path).parquet(*wanted)
        if after is not None:
            rows = rows.filter(F.col(table.cluster) > F.lit(after))
        return rows.orderBy(table.cluster).limit(limit)

    def _derive(self, load: str, runs: list[str]) -> None:
        self.ids.finish(load, runs)
        kept = self.kept()
        if not kept:
            return
        facts = self.wh.facts_of(runs)
        there = set(self.wh.run_folders(runs)) if facts is not None else set()
        for table in kept:
            if facts is not None:
                self._write(table, facts, len(there) == 1)
            for name in table.folders:
                for folder in self.wh.run_folders(runs, name):
                    if folder not in there:
                        self.wh.remove(f"{self.wh.path}/{name}/{folder}")

    def recover(self) -> None:
        """Make good what changes that never closed left behind."""
        if not self.ids.exists:
            self.ids.rebuild()
            return
        self.ids.refresh()
        if lost := self.ids.unfinished():
            self._derive(self.ids.begin(lost), lost)

    @contextmanager
    def changing(self, runs: Iterable[str]) -> Iterator[None]:
        """Facts of these runs change inside; what is derived from them follows, also after an error."""
        runs = list(runs)
        if not runs or self._inside:  # an outer change covers its runs
            yield
            return
        self.recover()
        load = self.ids.begin(runs)
        self._inside = True
        try:
            yield
        finally:
            self._inside = False
            self._derive(load, runs)
