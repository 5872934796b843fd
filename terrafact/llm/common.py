"""What the operators share: staged tables in the shared folder, and text as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task; a longer document is a piece of its own.
PIECE_BYTES = 1 << 21

#: Bytes of a batch that goes to a Python worker and comes back, unless the session says otherwise. A task holds several
#: copies, on both sides of the pipe; Spark's own 64 MB make up hundreds of megabytes of an executor beside its heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: White space of the word rule `[^\x20\x09-\x0D]+`, fixed by the contract.
SPACES = b" \t\n\v\f\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


# --- staged tables -----------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; where it is unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="terrafact-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Lets Python workers that see this file system import the package from where the driver has
    it; elsewhere it is installed or sent along, as any package is. Workers of another environment are processes
    of their own, so every operator calls this before its first job. Also bounds the batches that workers get."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    known = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known.get("PYTHONPATH")])])


class Scratch:
    """Tables written by one operator call under the shared folder. A lost executor costs the
    tasks that it ran, since every later stage reads them again from there."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, written as Parquet and read back. Shuffle files of the write are garbage then;
        they go when the driver's collector finds that out, which it is asked to do at once: left to
        itself it may take until the disks are full."""
        path = self.new_path(name)
        df.write.parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Removes staged tables that nothing reads any more."""
        for df in frames:
            for file in df.inputFiles()[:1]:
                self.remove(file.rsplit("/", 1)[0])

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of docs has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


# --- text as arrays ----------------------------------------------------------------------


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and where each text starts (one more at the end).
    Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(buf: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents in groups of about `limit` bytes: first and last row, bytes, offsets."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums whose differences, scaled back by `range_hash`, are hashes of byte ranges."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = buf.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(buf) + 1)[0][: len(buf)]
    np.cumsum(values, out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(31))


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    h = sums[end] - sums[start]
    h *= powers(len(sums))[1][start]
    return mix(h + (end - start).astype(np.uint64) * _BASE)


def byte_table(breaks: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(breaks)] = False
    return out


#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_WORD = byte_table(SPACES)


def word_spans(buf: np.ndarray, at: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at[(at > 0) & (at < len(buf))]] = True
    edges = np.flatnonzero(edge)
    keep = inside[edges[:-1]]
    return edges[:-1][keep], edges[1:][keep]


def word_hashes(buf: np.ndarray, at: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word with A-Z in lower case: its hash, its start, and how many words come before each
    text (one entry more than texts)."""
    start, end = word_spans(buf, at, is_word)
    hashes = range_hash(prefix_hash(LOWER[buf]), start, end)
    return hashes, start, np.searchsorted(start, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, with the text's index; a text of 1 to
    k - 1 words has the whole sequence as its one shingle."""
    n = len(hashes)
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    acc = np.zeros(n, np.uint64)
    step = np.uint64(1)
    counts = np.diff(first)
    for j in range(k):
        step = np.uint64(int(step) * int(_BASE) % (1 << 64))
        if j < n:
            acc[: n - j] += hashes[j:] * step
    left = first[docs + 1] - np.arange(n)
    whole = left >= k
    out, owner = mix(acc[whole]), docs[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        # shorter sequences sum what they have, salted by their length
        total, step = np.zeros(len(short), np.uint64), np.uint64(1)
        for j in range(k - 1):
            step = np.uint64(int(step) * int(_BASE) % (1 << 64))
            has = counts[short] > j
            total[has] += hashes[first[short[has]] + j] * step
        total += counts[short].astype(np.uint64) * _MIX[1]
        out, owner = np.concatenate([out, mix(total)]), np.concatenate([owner, short])
    return out, owner


def distinct_per_text(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ordered by text, then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
