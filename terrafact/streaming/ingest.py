"""New files of a folder become facts once, through Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrafact.config import ConfigError, SourceConfig
from terrafact.functions.keys import uuid5
from terrafact.operators.registry import pending_files, run_log_rows
from terrafact.plans.jobs import LoadFailed, ingest_feed
from terrafact.sources import feeds as FD
from terrafact.sources.feeds import FILE, POSITION, RUN
from terrafact.sources.warehouse import Warehouse


def stream_ingest(
    wh: Warehouse,
    source: SourceConfig,
    folder: str,
    header: Sequence[str],
    checkpoint: str,
    *,
    max_files: int | None = None,
    available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Start a query that loads every new CSV file of a folder as one run.

    The stream carries file names only; each micro-batch reads its files as a
    batch load would, large ones in parts. Files count in order of arrival, then
    by path. The run id is a function of source and file, and runs are written
    whole: a micro-batch that is tried again replaces what its first try left.
    Facts need a key for that, so a source without ``unique_key`` is refused. A
    file that is given up, or whose header is not ``header``, does not stop the
    stream; the log of runs tells.
    """
    source.validate()
    if not source.unique_key:
        raise ConfigError("a streamed source needs a unique_key")
    names = [h.lower() for h in header]
    if len(set(names)) < len(names):
        raise ConfigError("a streamed header cannot repeat a name")
    listing = "path string, modificationTime timestamp, length bigint, content binary"  # fixed by the source
    reader = wh.spark.readStream.format("binaryFile").schema(listing)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrived = reader.load(folder).select("path", "modificationTime")  # contents are not read

    def load(batch: DataFrame, _: int) -> None:
        spark = wh.spark
        files = sorted((r["modificationTime"], r["path"]) for r in batch.collect())
        files = [(FD.qualify(spark, p), i) for i, (_, p) in enumerate(files)]
        if not files:
            return
        run = uuid5(F.concat_ws("|", F.lit("stream"), F.lit(source.name), F.col("source_file")))
        listed = spark.createDataFrame(files, f"source_file string, {POSITION} int").withColumn(RUN, run)
        # Files that came in by another way are left alone.
        own = uuid5(F.concat_ws("|", F.lit("stream"), F.lit(source.name), F.col("source_file")))
        others = wh.read("run_log").filter(F.col("ingest_run_id") != own)
        todo = pending_files(listed, others).orderBy(POSITION).collect()
        good = [r for r in todo if [h.lower() for h in FD.read_header(spark, r["source_file"])] == names]
        odd = [(r["source_file"], r[RUN], "given up") for r in todo if r not in good]
        if odd:
            wh.append_log("run_log", run_log_rows(spark, source.name, odd))
        if not good:
            return
        feed = FD.read_csv(spark, [r["source_file"] for r in good], lenient=True, multi_line=source.multi_line)
        feed = feed.join(listed.withColumnRenamed("source_file", FILE), FILE)
        try:
            runs = [(r["source_file"], r[RUN]) for r in good]
            ingest_feed(wh, source, feed, files=runs if len(good) == len(files) else None)
        except LoadFailed:
            pass

    writer = arrived.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
