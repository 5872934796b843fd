"""Operator 10: token counts by separator scan.

A flat token file holds the ids of many documents back to back, each followed by an end-of-document
id, and no index. The files are read in blocks of equal size; inside a block numpy finds all
separators at once; a running sum of separators and a running maximum of the last separator's
place, over the blocks of a file, give each block the number of documents before it and the place
where its first document began. So a document may span any number of blocks, and the work of a task is
one block.

Files are reached through `pyarrow.fs` by the URI that Spark uses (file, hdfs, s3, gs).

Edge cases: an empty file has no documents; separators in a row are empty documents of 0 tokens; ids
behind the last separator are a last document with `ended` false; a file whose size is no whole
number of ids is an error that names it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import MEMORY, model

#: Ids in one block.
BLOCK_IDS = 1 << 21


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_flat(docs: DataFrame, path: str, separator: int, folder: str) -> DataFrame:
    """Writes the ids of all texts to flat files of 16-bit ids under `folder`, one per task, and
    returns which documents stand in which file, in order: file, ordinal, doc_id. No lengths or
    places are kept. A file gets a new name at each try of a task, and only the names of tries
    that Spark commits are in the result, so lost or repeated tasks leave no trace in it. Write the
    result before using it. Models of up to 65,536 pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        end = np.array([separator], np.uint16).tobytes()
        known: dict[str, bytes] = {}

        def look(word: str) -> bytes:
            if len(known) >= MEMORY:
                known.clear()
            found = np.array(m.encode_word(word), np.uint16).tobytes()
            if len(word) <= 64:
                known[word] = found
            return found

        system, place = _open(folder)
        name = f"{uuid.uuid4().hex}.ids"
        out, done = None, 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(f"{place}/{name}")
            get = known.get
            for text in batch.column("text"):
                out.write(b"".join([get(w) or look(w) for w in m.words(text.as_py() or "")]) + end)
            yield pa.record_batch(
                [pa.array([name] * len(batch)), pa.array(range(done, done + len(batch)), pa.int64()), batch.column("doc_id")],
                ["file", "ordinal", "doc_id"],
            )
            done += len(batch)
        if out is not None:
            out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal bigint, doc_id {kind}")


def blocks_of(spark: SparkSession, folder: str, names: DataFrame, width: int, block_ids: int) -> DataFrame:
    """file, start, size in bytes of each block of the named files."""
    sizes = (
        spark.read.format("binaryFile")
        .load(f"{folder}/*.ids")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length"))
    )
    step = block_ids * width
    return (
        sizes.join(names.select("file").distinct(), "file", "left_semi")
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step))))
        .select("file", "start", "length", F.least(F.lit(step), F.col("length") - F.col("start")).alias("size"))
    )


def scan(blocks: DataFrame, folder: str, separator: int, width: int) -> DataFrame:
    """file, ordinal, n_tokens, ended: the documents of flat token files, from their blocks."""
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open(folder)
        for batch in batches:
            for file, start, length, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length", "size")), strict=True):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are no whole number of ids of {width} bytes")
                with system.open_input_file(f"{place}/{file}") as f:
                    ids = np.frombuffer(f.read_at(size, start), kind)
                ends = np.flatnonzero(ids == separator) + start // width
                yield pa.record_batch(
                    [
                        pa.array([file]), pa.array([start // width], pa.int64()), pa.array([length // width], pa.int64()),
                        pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    ["file", "start", "total", "n", "last", "ends"],
                )

    # one block a task at most times, however small the list of blocks is
    found = blocks.repartition(F.col("file"), F.col("start")).mapInArrow(
        find, "file string, start bigint, total bigint, n bigint, last bigint, ends array<bigint>"
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    placed = found.select(
        "file", "ends", "total", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
        F.coalesce(F.max(F.lit(1)).over(after), F.lit(0)).alias("more"),
    )
    lengths = placed.withColumn("from", F.concat(F.array("previous"), F.slice("ends", 1, F.greatest(F.col("n") - 1, F.lit(0)))))
    ended = lengths.filter("n > 0").select(
        "file", "first", F.posexplode(F.arrays_zip("from", "ends")).alias("i", "x")
    ).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"),
        (F.col("x.ends") - F.col("x.from") - 1).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    last_end = F.when(F.col("n") > 0, F.element_at("ends", -1)).otherwise(F.col("previous"))
    rest = placed.filter("more = 0").select(
        "file", (F.col("first") + F.col("n")).alias("ordinal"),
        (F.col("total") - last_end - 1).alias("n_tokens"), F.lit(False).alias("ended"),
    ).filter("n_tokens > 0")
    return ended.unionByName(rest)
