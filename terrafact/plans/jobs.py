"""Loads, replays and exports against a warehouse."""

from __future__ import annotations

import logging
import uuid
import warnings
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terrafact.config import ConfigError, SourceConfig
from terrafact.functions.places import country_of_path
from terrafact.functions.rules import field_kinds
from terrafact.operators import dimensions as D
from terrafact.operators import facts as FA
from terrafact.operators import registry as R
from terrafact.operators import transform as TR
from terrafact.operators.analytics import orphaned_raw
from terrafact.operators.keep import first_by_sort, last_per_key
from terrafact.operators.runtables import fact_digests
from terrafact.plans import fact_load as PL
from terrafact.plans.export import export_frame, write_export
from terrafact.sources import feeds as FD
from terrafact.sources.feeds import FILE, MALFORMED, POSITION, RAW, ROW, RUN
from terrafact.sources.warehouse import Warehouse

log = logging.getLogger("terrafact")

# Files per job: bounds the file list that is joined to the rows and collected.
# Results do not depend on it.
FILES_PER_JOB = 10_000
LOOK_THREADS = 8
# Up to so many files are counted while their rows are written, a few figures each; more are
# counted by a scan of the staging table.
OBSERVED_FILES = 32
MISSING = "no such file"


@dataclass(frozen=True)
class RunReport:
    """What became of one file."""

    source_name: str
    source_file: str
    ingest_run_id: str
    rows: int
    skipped: int
    inserted: int
    error: str | None = None


class LoadFailed(TR.DatasetAborted):
    """One or more files were given up; the others of the same load are in."""

    def __init__(self, reports: list[RunReport]):
        self.reports = reports
        failed = [f"{r.source_file}: {r.error}" for r in reports if r.error]
        super().__init__("; ".join(failed))


# Registries


def register_source(wh: Warehouse, name: str, description: str | None = None) -> dict:
    """Add a source to the registry; a known name raises Conflict."""
    row = R.source_row(wh.spark, name, description)
    if not wh.read("import_sources").filter(F.col("name") == F.lit(name)).isEmpty():
        raise R.Conflict(f"source {name!r} is registered already")
    wh.append_log("import_sources", row)
    return {"name": name, "description": description}


def register_fields(wh: Warehouse, source: SourceConfig) -> dict[str, str]:
    """Declare a source's fields and return all that are registered for it."""
    registry = wh.read("import_schema")
    known = R.load_schema(registry, source.name)
    if any(known.get(n) != t for n, t in source.schema.items()):
        wh.write_snapshot(
            "import_schema", R.register_schema(R.schema_rows(wh.spark, source), registry)
        )
    return known | source.schema


# Fact loads


def _file_list(wh: Warehouse, paths: Sequence[str], runs: Sequence[str]) -> DataFrame:
    rows = [(FD.qualify(wh.spark, p), p, r, i) for i, (p, r) in enumerate(zip(paths, runs))]
    return wh.spark.createDataFrame(
        rows, f"{FILE} string, _path string, {RUN} string, {POSITION} int"
    )


def ingest_files(
    wh: Warehouse,
    source: SourceConfig,
    paths: str | Sequence[str],
    *,
    merge: str = "replace",
    stale: str = "reject",
) -> list[RunReport]:
    """Load CSV files of one source as facts: one job, one run per file.

    A file with a malformed record or a failure whose policy is to give the
    file up leaves no facts and no dimension rows; the others go in and
    LoadFailed tells which did not. Raw rows are kept either way.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    source.validate()
    with ThreadPoolExecutor(LOOK_THREADS) as pool:
        there = list(pool.map(wh.exists, paths))
    missing = [RunReport(source.name, p, "", 0, 0, 0, MISSING) for p, ok in zip(paths, there) if not ok]
    paths = [p for p, ok in zip(paths, there) if ok]
    if not paths:
        raise LoadFailed(missing)
    feed = FD.read_csv(wh.spark, paths, lenient=True, multi_line=source.multi_line)
    runs = [str(uuid.uuid4()) for _ in paths]
    files = _file_list(wh, paths, runs)
    options = {"merge": merge, "stale": stale, "files": list(zip(paths, runs))}
    feed = feed.join(files, FILE).withColumn(FILE, F.col("_path")).drop("_path")
    if not missing:
        return ingest_feed(wh, source, feed, **options)
    try:
        reports = ingest_feed(wh, source, feed, **options)
    except LoadFailed as e:
        reports = e.reports
    raise LoadFailed(reports + missing)


def ingest_feed(
    wh: Warehouse,
    source: SourceConfig,
    feed: DataFrame,
    *,
    merge: str = "replace",
    stale: str = "reject",
    audit: bool = True,
    files: Sequence[tuple[str, str]] | None = None,
) -> list[RunReport]:
    """Load a feed whose rows carry ``_file``, ``_run``, ``_position`` and ``_row``.

    The feed is read once: cleaned, typed and linked rows go to a staging
    table that every later step reads the columns it needs from. The log of
    runs is written last: a load that breaks off leaves no facts and no raw
    rows of its own, and its files are still to be loaded. With ``audit=False``
    the runs are there already; what they hold stays until it is replaced, and a run
    whose facts come out as they are is left alone. ``files`` names file and run of each position
    where they are known beforehand: rows are then counted as they are written.
    """
    source.validate()
    source.validate_columns(FD.feed_columns(feed))
    schema = register_fields(wh, source)
    kinds = field_kinds(source.by_canonical)
    country = country_of_path(F.col(FILE))

    cleaned = FD.clean(FD.drop_excluded(feed, source.exclude_columns))
    cleaned = cleaned.withColumn(RAW, FA.raw_json(cleaned))
    rows = TR.apply_transforms(cleaned, source, blame=True)
    if MALFORMED in rows.columns:
        level = F.when(F.col(MALFORMED), F.lit(2)).otherwise(F.col(TR.LEVEL))
        blame = F.when(F.col(MALFORMED), F.lit("malformed record")).otherwise(F.col(TR.BLAME))
        rows = rows.withColumns({TR.LEVEL: level, TR.BLAME: blame})
    else:
        rows = rows.withColumn(MALFORMED, F.lit(False))
    linked = PL.link(rows, source, country)

    folder = wh.staging()
    runs: list[str] = []
    inserted: dict[str, int] | None = None
    started = wh.spark.range(1).select(F.current_timestamp()).first()[0]
    try:
        counts = _write_counted(linked, folder, len(files or ()))
        stage = wh.spark.read.schema(linked.schema).parquet(folder)
        outcome = _outcome(stage, source) if counts is None else _observed_outcome(counts, files, source)
        runs = [r.ingest_run_id for r in outcome]
        if audit:
            _write_raw(wh, source, stage)
        bad = [r.ingest_run_id for r in outcome if r.error]
        if len(bad) < len(runs):
            good = stage.filter(F.col(TR.LEVEL) == 0)
            good = good.filter(~F.col(RUN).isin(bad)) if bad else good
            good = TR.check_complete(good, schema, source.derived_names, stale)
            before = wh.read("dim_location"), wh.read("dim_time")
            _merge_dimensions(wh, good, kinds, merge, f"{folder}-dims")
            extra = tuple(TR.unmapped_columns(cleaned, source))
            again = None if audit else (f"{folder}-facts", [r for r in runs if r not in bad], started)
            inserted = _publish_facts(wh, source, good, schema, extra, runs, merge, before, again)
        reports = _with_inserted(wh, outcome, inserted)
        done = [(r.source_file, r.ingest_run_id, "given up" if r.error else "loaded") for r in reports]
        if done:
            wh.append_log("run_log", R.run_log_rows(wh.spark, source.name, done))
    except Exception:
        if audit:
            wh.remove_runs(runs)
        raise
    finally:
        wh.remove(folder)
        wh.remove(f"{folder}-dims")
        wh.remove(f"{folder}-facts")
    for r in reports:
        log.info("%s", r)
    if any(r.error for r in reports):
        raise LoadFailed(reports)
    return reports


def _write_counted(linked: DataFrame, folder: str, files: int) -> dict | None:
    """Write the staging table and count what becomes of each file's rows on the way."""
    if not 0 < files <= OBSERVED_FILES:
        linked.write.parquet(folder)
        return None
    figures: list[Column] = []
    for i in range(files):
        here, gave_up = F.col(POSITION) == i, F.col(TR.LEVEL) == 2
        figures += [
            F.count_if(here).alias(f"rows{i}"),
            F.count_if(here & (F.col(TR.LEVEL) == 1)).alias(f"skipped{i}"),
            F.min_by(F.struct(TR.BLAME, ROW), F.when(here & gave_up, F.col(ROW))).alias(f"first{i}"),
        ]
    seen = Observation()
    linked.observe(seen, *figures).write.parquet(folder)
    return seen.get or None  # nothing where Spark saw that there are no rows


def _observed_outcome(counts: dict, files: Sequence[tuple[str, str]], source: SourceConfig) -> list[RunReport]:
    """What ``_outcome`` finds by a scan, from figures of the write."""
    out = []
    for i, (path, run) in enumerate(files):
        first = counts[f"first{i}"]
        error = f"{first[0]} at row {first[1]}" if first is not None else None
        out.append(RunReport(source.name, path, run, counts[f"rows{i}"], counts[f"skipped{i}"], 0, error))
    return sorted((r for r in out if r.rows), key=lambda r: r.source_file)


def _outcome(stage: DataFrame, source: SourceConfig) -> list[RunReport]:
    """Rows, skipped rows and reason to give up, per run. As long as the file list."""
    gave_up = F.col(TR.LEVEL) == 2
    found = (
        stage.groupBy(RUN, FILE)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(TR.LEVEL) == 1).alias("skipped"), F.count_if(gave_up).alias("bad"))
        .groupBy(RUN)
        .agg(F.min(FILE).alias(FILE), *[F.sum(c).alias(c) for c in ("n", "skipped", "bad")])
        .collect()
    )
    # Reasons are looked for only where there are any: they are folded by sorting, the counts are not.
    firsts = {}
    if any(r["bad"] for r in found):
        first = F.min_by(F.struct(TR.BLAME, ROW), ROW)
        firsts = dict(stage.filter(gave_up).groupBy(RUN).agg(first.alias("first")).collect())
    return [
        RunReport(
            source.name,
            r[FILE],
            r[RUN],
            r["n"],
            r["skipped"],
            0,
            f"{firsts[r[RUN]][0]} at row {firsts[r[RUN]][1]}" if r["bad"] else None,
        )
        for r in sorted(found, key=lambda r: r[FILE])
    ]


def _write_raw(wh: Warehouse, source: SourceConfig, stage: DataFrame) -> None:
    # Files of one load are a microsecond apart, in list order, which a replay follows.
    at = F.timestamp_micros(F.unix_micros(F.current_timestamp()) + F.col(POSITION))
    wh.write_runs(
        "raw_imports",
        stage.filter(~F.col(MALFORMED)).select(
            F.col(ROW).alias("raw_import_id"),
            F.lit(None).cast("bigint").alias("source_id"),
            F.col(FILE).alias("source_file"),
            F.col(RAW).alias("raw_data"),
            at.alias("imported_at"),
            F.lit(source.name).alias("source_name"),
            F.col(RUN).alias("ingest_run_id"),
        ),
    )


def _changed(wh: Warehouse, facts: DataFrame, runs: list[str]) -> list[str]:
    """Those of the runs whose facts are to be others than they are, or none any more. Where digests are
    kept, nothing of the stored facts is read for that."""
    stored = wh.facts_of(runs)
    if stored is None:
        return runs
    kept = any(t.name == "fact_digests" for t in wh.derived.kept())
    now = wh.derived.read("fact_digests").filter(F.col("ingest_run_id").isin(runs)) if kept else fact_digests(stored)
    parts = ["source_name", "ingest_run_id", "n", "total", "parity"]
    same = fact_digests(facts).select(*parts).join(now.select(*parts), parts, "left_semi")
    gone = now.select("ingest_run_id").distinct()
    equal = {r[0] for r in same.select("ingest_run_id").collect()}  # runs of this replay
    new = {r[0] for r in facts.select("ingest_run_id").distinct().unionByName(gone).distinct().collect()}
    return [r for r in runs if r in new and r not in equal]


def _remove_stale(wh: Warehouse, source: SourceConfig, runs: list[str], started) -> None:
    """Facts of replayed runs that the replay did not write again."""
    facts = wh.read("normalized_imports").filter(
        (F.col("source_name") == F.lit(source.name)) & F.col("ingest_run_id").isin(runs)
    )
    old = facts.filter(F.col("inserted_at") < F.lit(started)).select("ingest_run_id").distinct()
    for r in old.collect():
        wh.remove(f"{wh.path}/normalized_imports/source_name={source.name}/ingest_run_id={r[0]}")


def _merge_dimensions(wh: Warehouse, good: DataFrame, kinds, merge: str, folder: str) -> None:
    # Files are loaded in list order: within one the first row of a place
    # wins, and a later file's row replaces an earlier one's. A dimension that
    # already has all these rows is not written again.
    by_file = good.withColumn(ROW, F.struct((-F.col(POSITION)).alias("p"), F.col(ROW).alias("r")))

    def merge_into(table: str, rows: DataFrame, upsert) -> None:
        rows.write.parquet(f"{folder}/{table}")
        new, known = wh.spark.read.schema(rows.schema).parquet(f"{folder}/{table}"), wh.read(table)
        if not new.select(*known.columns).exceptAll(known).isEmpty():
            wh.write_snapshot(table, upsert(new, known))

    if merge == "coalesce":
        # What each file leaves out is filled from the files before it, one by one.
        so_far = D.location_versions(good, kinds, wh.read("dim_location"), merge)
        merge_into("dim_location", last_per_key(so_far, "id", POSITION).drop(POSITION), D.upsert_location)
    else:
        merge_into("dim_location", D.location_rows(by_file, kinds), lambda n, k: D.upsert_location(n, k, merge))
    if "year" in kinds:
        merge_into("dim_time", D.time_rows(by_file, kinds), D.upsert_time)


def _publish_facts(
    wh: Warehouse,
    source: SourceConfig,
    good: DataFrame,
    schema: dict[str, str],
    extra: tuple[str, ...],
    runs: list[str],
    merge: str,
    before: tuple[DataFrame, DataFrame],
    again: tuple[str, list[str], object] | None,
) -> dict[str, int] | None:
    """Write the facts of new runs; of runs made again, those that differ. ``again`` names a folder for
    what they come out as, the runs that may change, and when the replay began. Returns how many
    facts each new run has, where they were counted."""
    wh.derived.recover()
    facts = _plan_facts(wh, source, good, schema, extra, runs, merge, before)
    if again is None:
        with wh.derived.changing(runs):
            return _write_facts(wh, facts, runs)
    folder, mine, started = again
    facts.write.parquet(folder)
    facts = wh.spark.read.schema(facts.schema).parquet(folder)
    todo = _changed(wh, facts, mine)
    with wh.derived.changing(todo):
        _write_facts(wh, facts.filter(F.col("ingest_run_id").isin(todo)), todo)
        _remove_stale(wh, source, todo, started)
    return None


def _plan_facts(
    wh: Warehouse,
    source: SourceConfig,
    good: DataFrame,
    schema: dict[str, str],
    extra: tuple[str, ...],
    runs: list[str],
    merge: str,
    before: tuple[DataFrame, DataFrame],
) -> DataFrame:
    # A file's look-ups see the dimensions as of that file, whatever is loaded with it.
    kinds = field_kinds(source.by_canonical)
    places = D.location_versions(good, kinds, before[0], merge)
    periods = D.time_versions(good, kinds, before[1])
    rows = good.withColumns(
        {
            "raw_import_id": F.col(ROW),
            "ingest_run_id": F.col(RUN),
            ROW: F.struct(F.col(POSITION).alias("p"), F.col(ROW).alias("r")),
        }
    )
    facts = PL.finish(rows, source, places, periods, schema, extra)
    if source.unique_key:
        # A run that is written again does not conflict with itself. Ids come straight
        # from the staging table: look-ups may drop some of them, which changes nothing.
        stored = wh.derived.ids.conflicts(good, but=runs)
        facts = first_by_sort(facts, "id", ROW).join(stored, "id", "left_anti")
    return facts.drop(ROW)


def _write_facts(wh: Warehouse, facts: DataFrame, runs: list[str]) -> dict[str, int] | None:
    if len(runs) > 1:
        # The de-duplication spread every run over all tasks; without this each
        # task would write a file for each run. Large runs are split, small
        # ones merged.
        facts = facts.hint("rebalance", F.col("ingest_run_id"))
    facts = facts.withColumn("inserted_at", F.current_timestamp())
    if not 0 < len(runs) <= OBSERVED_FILES:
        wh.write_runs("normalized_imports", facts)
        return None
    seen = Observation()
    figures = [F.count_if(F.col("ingest_run_id") == F.lit(r)).alias(f"n{i}") for i, r in enumerate(runs)]
    wh.write_runs("normalized_imports", facts.observe(seen, *figures))
    counts = seen.get
    return {r: counts[f"n{i}"] for i, r in enumerate(runs)} if counts else None


def _with_inserted(wh: Warehouse, outcome: list[RunReport], counts: dict[str, int] | None) -> list[RunReport]:
    if counts is None:
        facts = wh.facts_of([r.ingest_run_id for r in outcome])
        counts = dict(facts.groupBy("ingest_run_id").count().collect()) if facts is not None else {}
    out = []
    for r in outcome:
        inserted = 0 if r.error else counts.get(r.ingest_run_id, 0)
        lost = r.rows - r.skipped - inserted
        if not r.error and lost:
            warnings.warn(
                f"{r.source_file}: {lost} rows gave no fact (key loaded already, or look-up "
                "without a value)",
                stacklevel=4,
            )
        out.append(RunReport(**{**r.__dict__, "inserted": inserted}))
    return out


def pending(wh: Warehouse, source: SourceConfig) -> list[str]:
    """Configured files of a source that were not loaded yet, in order."""
    if not source.files:
        return []
    files = wh.spark.createDataFrame([(f,) for f in source.files], "source_file string")
    todo = {r[0] for r in R.pending_files(files, wh.read("run_log")).collect()}
    return [f for f in source.files if f in todo]


def run_source(
    wh: Warehouse, source: SourceConfig, file: str | None = None, **options
) -> list[RunReport]:
    """Load a source's new files; a file named here is loaded even if it was before."""
    paths = [file] if file else pending(wh, source)
    reports: list[RunReport] = []
    failed = False
    for start in range(0, len(paths), FILES_PER_JOB):
        try:
            reports += ingest_files(wh, source, paths[start : start + FILES_PER_JOB], **options)
        except LoadFailed as e:
            failed = True
            reports += e.reports
    if failed:
        raise LoadFailed(reports)
    return reports


def run_all(wh: Warehouse, sources: Iterable[SourceConfig], **options) -> list[RunReport]:
    """Load the new files of every source; a source that fails does not stop the rest."""
    reports: list[RunReport] = []
    failed = False
    for source in sources:
        try:
            reports += run_source(wh, source, **options)
        except LoadFailed as e:
            failed = True
            reports += e.reports
    if failed:
        raise LoadFailed(reports)
    return reports


def replay(
    wh: Warehouse, source: SourceConfig, files: Sequence[str] | None = None, **options
) -> list[RunReport]:
    """Normalise raw rows again under the present definition, run by run in place."""
    raw = wh.read("raw_imports").filter(F.col("source_name") == F.lit(source.name))
    if files is not None:
        raw = raw.filter(F.col("source_file").isin(list(files)))
    columns = [f.column for f in source.by_canonical.values()]
    if source.unmapped == "keep":
        found = raw.select(F.explode(F.json_object_keys("raw_data")).alias("k")).distinct()
        columns += [r["k"] for r in found.collect()]  # names of columns
    feed = FA.read_raw(raw, [c.lower() for c in columns])
    # Earlier runs come first, as they were loaded.
    order = raw.groupBy("ingest_run_id").agg(F.min("imported_at").alias("t")).collect()
    if not order:
        return []
    order.sort(key=lambda r: (r["t"], r["ingest_run_id"]))
    runs = wh.spark.createDataFrame(
        [(r["ingest_run_id"], i) for i, r in enumerate(order)],
        f"ingest_run_id string, {POSITION} int",
    )
    feed = feed.join(runs, "ingest_run_id").withColumnRenamed("ingest_run_id", RUN)
    plain = SourceConfig(**{**_arguments(source), "exclude_columns": ()})
    return ingest_feed(wh, plain, feed, audit=False, **options)


def _arguments(source: SourceConfig) -> dict:
    return {k: v for k, v in source.__dict__.items() if k != "by_canonical"}


# Dimension loads


def ingest_dim(wh: Warehouse, source: SourceConfig, path: str, merge: str = "replace") -> int:
    """Load a dimension file and log it; returns the rows taken in.

    Nothing is written unless the whole file is good.
    """
    source.validate()
    if source.target is None:
        raise ConfigError(f"dimension source {source.name!r} has no target")
    if not source.unique_key:
        warnings.warn(f"{source.name}: no unique_key, loading again adds rows", stacklevel=2)
    feed = FD.read_csv(wh.spark, path, multi_line=source.multi_line)
    source.validate_columns(FD.feed_columns(feed))
    cleaned = FD.clean(FD.drop_excluded(feed, source.exclude_columns))
    rows = TR.apply_transforms(cleaned, source)
    folder = wh.staging()
    try:
        rows.write.parquet(folder)
        stage = wh.spark.read.schema(rows.schema).parquet(folder)
        TR.check_abort(stage)
        kept = TR.kept_rows(stage)
        kinds = field_kinds(source.by_canonical)
        if source.target == "dim_location":
            new = D.location_load_rows(kept, kinds, source.unique_key)
            merged = D.upsert_location(new, wh.read("dim_location"), merge)
        else:
            new = D.time_load_rows(kept, kinds, source.unique_key)
            merged = D.upsert_time(new, wh.read("dim_time"))
        wh.write_snapshot(source.target, merged)
        count = kept.count()
    finally:
        wh.remove(folder)
    wh.append_log("dim_file_log", R.log_row(wh.spark, source.name, source.target, path, count))
    return count


def pending_dim(wh: Warehouse, source: SourceConfig) -> list[str]:
    if not source.files:
        return []
    rows = [(source.name, f) for f in source.files]
    files = wh.spark.createDataFrame(rows, "source_name string, file_path string")
    todo = {r["file_path"] for r in R.pending_dim_files(files, wh.read("dim_file_log")).collect()}
    return [f for f in source.files if f in todo]


def run_dim(
    wh: Warehouse, source: SourceConfig, file: str | None = None, merge: str = "replace"
) -> dict[str, int]:
    """Load a dimension source's new files in order, or one file in any case."""
    paths = [file] if file else pending_dim(wh, source)
    return {p: ingest_dim(wh, source, p, merge) for p in paths}


def run_all_dims(
    wh: Warehouse, sources: Iterable[SourceConfig], merge: str = "replace"
) -> dict[str, dict[str, int]]:
    return {s.name: run_dim(wh, s, merge=merge) for s in sources}


# Clean-up


def remove_orphaned_raw(wh: Warehouse, days: int = 7) -> int:
    """Remove raw rows older than some days that no fact refers to; returns how many.

    Only runs that have such rows are written again.
    """
    raw = wh.read("raw_imports")
    keys = ["ingest_run_id", "raw_import_id"]
    lost = orphaned_raw(raw, wh.read("normalized_imports"), F.current_timestamp(), days).select("source_name", *keys)
    counts = lost.groupBy("source_name", "ingest_run_id").agg(F.count(F.lit(1)).alias("n")).collect()  # runs
    if not counts:
        return 0
    folder = wh.staging()
    try:
        runs = [r["ingest_run_id"] for r in counts]
        left = raw.filter(F.col("ingest_run_id").isin(runs)).join(lost.select(*keys), keys, "left_anti")
        left.write.parquet(folder)
        left = wh.spark.read.schema(raw.schema).parquet(folder)
        kept = {r[0] for r in left.select("ingest_run_id").distinct().collect()}
        wh.write_runs("raw_imports", left)
        wh.remove_runs([run for run in runs if run not in kept], ["raw_imports"])
    finally:
        wh.remove(folder)
    return sum(r["n"] for r in counts)


# Exports


def export_run(
    wh: Warehouse, source_name: str, run_id: str, base: str, strict_types: bool = False
) -> str:
    """Write a run flat and typed under ``base/source``, by year."""
    fact = wh.read("normalized_imports").filter(
        (F.col("source_name") == F.lit(source_name)) & (F.col("ingest_run_id") == F.lit(run_id))
    )
    schema = R.load_schema(wh.read("import_schema"), source_name)
    df = export_frame(fact, wh.read("dim_location"), wh.read("dim_time"), schema, strict_types)
    path = f"{base.rstrip('/')}/{source_name}"
    write_export(df, path, [run_id])
    return path


def export_dims(wh: Warehouse, base: str) -> dict[str, str]:
    """Write both dimensions beside the exported sources."""
    out = {}
    for table, name in (("dim_location", "locations"), ("dim_time", "times")):
        out[table] = f"{base.rstrip('/')}/dims/{name}"
        wh.read(table).write.mode("overwrite").parquet(out[table])
    return out
