"""The integrity report of a warehouse, worked out for what changed since the last one.

What a figure depends on is written down with it as a stamp. Files are never changed in
place, so the names of a run's files stand for its contents; a dimension is stood for by an order-free
digest (count and sum of hashes) of the ids of each bucket. Runs whose files are the ones they
were are joined again only in buckets of a dimension that differ, and not read at all when
there are none.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafact.operators.analytics import dimension_checks
from terrafact.sources.warehouse import Warehouse

BUCKETS = 16
AXES = {"location_id": "dim_location", "time_id": "dim_time"}
STATE = "part string, run string, bucket int, stamp string, violations bigint"
CHECKS = {"location_id": "fact_without_location", "time_id": "fact_without_time", "raw": "fact_without_raw", "id": "repeated_fact_id"}


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _stamps(df: DataFrame, partition: str) -> dict[str, str]:
    """For each folder of a partition column a digest of the names of its files."""
    names: dict[str, list[str]] = defaultdict(list)
    for path in df.inputFiles():
        if found := re.search(rf"/{partition}=([^/]*)/", path):
            names[unquote(unquote(found[1]))].append(path.rsplit("/", 1)[1])
    return {k: hashlib.md5("|".join(sorted(v)).encode()).hexdigest() for k, v in names.items()}


def _parents(dim: DataFrame) -> DataFrame:
    """bucket, parents: digest of the ids of each bucket."""
    rows = dim.select("id").distinct().groupBy(_bucket("id").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")
    )
    return rows.select("bucket", F.concat_ws(":", "n", "s").alias("parents"))


def _links(wh: Warehouse, axis: str, facts: DataFrame, todo: DataFrame) -> DataFrame:
    """Facts without a parent for each of the given runs and buckets."""
    keys = facts.filter(F.col(axis).isNotNull()).groupBy(F.col("ingest_run_id").alias("run"), axis).agg(F.count(F.lit(1)).alias("n"))
    few = keys.withColumn("bucket", _bucket(axis)).join(todo.filter(F.col("part") == axis), ["run", "bucket"], "left_semi")
    lost = few.join(wh.read(AXES[axis]).select(F.col("id").alias(axis)), axis, "left_anti")
    return lost.groupBy(F.lit(axis).alias("part"), "run", "bucket").agg(F.sum("n").alias("violations"))


def _without_raw(wh: Warehouse, runs: list[str], facts: DataFrame) -> DataFrame:
    keys = ["ingest_run_id", "raw_import_id"]
    raw = wh.read("raw_imports").filter(F.col("ingest_run_id").isin(runs)).select(*keys)
    lost = facts.filter(F.col("raw_import_id").isNotNull()).select(*keys).join(raw, keys, "left_anti")
    run = F.col("ingest_run_id").alias("run")
    return lost.groupBy(F.lit("raw").alias("part"), run, F.lit(0).alias("bucket")).agg(F.count(F.lit(1)).alias("violations"))


def _repeated(wh: Warehouse, buckets: list[int]) -> DataFrame:
    ids = wh.derived.ids.live(buckets).groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.groupBy(F.lit("id").alias("part"), F.lit("").alias("run"), "bucket").agg(F.count(F.lit(1)).alias("violations"))


def _newest(wh: Warehouse) -> int:
    """Number of the newest report."""
    path = f"{wh.path}/integrity"
    found = sorted((int(f[2:]) for f in wh.folders(path)), reverse=True)
    return next((n for n in found if wh.exists(f"{path}/v={n}/_SUCCESS")), 0)


def _wanted(wh: Warehouse) -> DataFrame:
    """part, run, bucket, stamp of every figure of the report, as it is now. The driver knows the names of
    files, as for any scan; the rest is worked out by Spark."""
    fact_files = _stamps(wh.read("normalized_imports"), "ingest_run_id")
    raw_files = _stamps(wh.read("raw_imports"), "ingest_run_id")
    runs = wh.spark.createDataFrame([(r, f, raw_files.get(r, "")) for r, f in fact_files.items()], "run string, files string, raw string")
    dead = wh.derived.ids.dead_stamp()
    ids = [("id", "", int(b), f"{f}/{dead}") for b, f in _stamps(wh.derived.ids.live(), "bucket").items()]
    out = wh.spark.createDataFrame(ids, "part string, run string, bucket int, stamp string")
    out = out.unionByName(runs.select(F.lit("raw").alias("part"), "run", F.lit(0).alias("bucket"), F.concat_ws("/", "files", "raw").alias("stamp")))
    each = runs.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    for axis, table in AXES.items():
        with_parents = each.join(_parents(wh.read(table)), "bucket", "left")
        stamp = F.concat_ws("/", "files", F.coalesce("parents", F.lit(""))).alias("stamp")
        out = out.unionByName(with_parents.select(F.lit(axis).alias("part"), "run", "bucket", stamp))
    return out


def check_changes(wh: Warehouse) -> DataFrame:
    """The report of ``check_integrity``; only runs and buckets that changed since the last call are read."""
    wh.derived.recover()
    base, last = f"{wh.path}/integrity", _newest(wh)
    old = wh.spark.read.schema(STATE).parquet(f"{base}/v={last}") if last else wh.spark.createDataFrame([], STATE)
    folder = wh.staging()
    key = ["part", "run", "bucket"]
    try:
        kept = old.select(*key, F.col("stamp").alias("_was"), F.col("violations").alias("_kept"))
        _wanted(wh).join(kept, key, "left").write.parquet(folder)
        now = wh.spark.read.parquet(folder)
        todo = now.filter(~F.col("stamp").eqNullSafe(F.col("_was")))
        found = wh.spark.createDataFrame([], "part string, run string, bucket int, violations bigint")
        runs = [r[0] for r in todo.filter("run <> ''").select("run").distinct().collect()]  # changed runs
        if runs:
            facts = wh.facts_of(runs)
            for axis in AXES:
                found = found.unionByName(_links(wh, axis, facts, todo))
            found = found.unionByName(_without_raw(wh, runs, facts))
        if buckets := [r[0] for r in todo.filter("part = 'id'").select("bucket").collect()]:
            found = found.unionByName(_repeated(wh, buckets))
        fresh = F.coalesce("violations", F.lit(0).cast("bigint"))
        same = F.col("stamp").eqNullSafe(F.col("_was"))
        state = now.join(found, key, "left").select(*key, "stamp", F.when(same, F.col("_kept")).otherwise(fresh).alias("violations"))
        state.write.parquet(f"{base}/v={last + 1}")
    finally:
        wh.remove(folder)
    for name in wh.folders(base):
        if int(name[2:]) < last:
            wh.remove(f"{base}/{name}")
    report = wh.spark.read.schema(STATE).parquet(f"{base}/v={last + 1}")
    totals = [F.coalesce(F.sum(F.when(F.col("part") == part, F.col("violations"))), F.lit(0)).alias(name) for part, name in CHECKS.items()]
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in CHECKS.values()])
    links = report.agg(*totals).select(F.inline(pairs))
    return links.unionByName(dimension_checks(wh.read("dim_location"), wh.read("dim_time")))
