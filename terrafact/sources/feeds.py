"""Text feeds: CSV scan, trimming, column choice.

A feed frame has one string column per (lower-cased) feed column plus columns
of its own: ``_file`` (where the row came from), ``_row`` (order of the row
within its feed, any orderable type), for lenient scans ``_malformed``, and
whatever a load adds to carry a row's run and raw text along.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafact.config import ConfigError
from terrafact.functions.text import quoted, trim_to_null

FILE, ROW, MALFORMED = "_file", "_row", "_malformed"
RUN, POSITION, RAW = "_run", "_position", "_raw"
META = (FILE, ROW, MALFORMED, RUN, POSITION, RAW)

HEADER_THREADS = 8


def feed_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def meta_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in META]


OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}

# How a line leaves the quotes. A quote opens a value only at the start of a
# field; a quoted value ends at a quote that is not doubled; what follows up to
# the comma is text. Possessive, so that long lines are matched without backtracking.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPENS = f"^{_FIELDS}{_QUOTED}$"
_STAYS_OPEN = f'^[^"]*+(?:""[^"]*+)*+(?:$|"[^,]*+,{_FIELDS}{_QUOTED}$)'
# In Java's patterns `$` also stands before a last line break, of which there are many kinds.
OPENS, STAYS_OPEN = _OPENS.replace("$", "\\z"), _STAYS_OPEN.replace("$", "\\z")

# Stand-ins for carriage returns inside values, which the parser would change.
_MARK, _CR, _SELF = "\ue000", "\ue000r", "\ue000m"


def _on_file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


# Local files are written with one slash or three, depending on the caller.
LOCAL = "^file:/+"


def qualify(spark: SparkSession, path: str) -> str:
    """The path as :func:`scanned_file` names it."""
    fs, p = _on_file_system(spark, path)
    return re.sub(LOCAL, "file:/", fs.makeQualified(p).toUri().toString())


def scanned_file() -> Column:
    """The file a scanned row came from."""
    return F.regexp_replace(F.col("_metadata.file_path"), LOCAL, "file:/")


def spanning_files(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Those files in which some quoted value spans lines.

    If every line that begins outside a quoted value also ends outside one,
    then, line by line, all of them do. The scan is split like any text file,
    and one job looks at all files.
    """
    lines = spark.read.text([literal(p) for p in paths])
    spans = lines.filter(F.col("value").rlike(OPENS)).select(scanned_file().alias("file"))
    return {r["file"] for r in spans.distinct().collect()}


def literal(path: str) -> str:
    """A path that Spark's readers take by name, not as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file, as written. An empty file has none.

    Only the first record is read, by the driver and without a Spark job.
    """
    fs, p = _on_file_system(spark, path)
    jvm = spark._jvm.java.io
    reader = jvm.BufferedReader(jvm.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        lines: list[str] = []
        while (line := reader.readLine()) is not None:
            if not lines and not line.removeprefix("\ufeff"):
                continue
            lines.append(line if lines else line.removeprefix("\ufeff"))
            if not re.search(_STAYS_OPEN if len(lines) > 1 else _OPENS, lines[-1]):
                break
    finally:
        reader.close()
    return next(csv.reader(["\n".join(lines)]), []) if lines else []


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    lenient: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Scan CSV files as text columns, lower-cased header, one frame for all files.

    A record that is shorter or longer than its header fails the scan; with
    ``lenient`` it is marked in ``_malformed`` instead, so that one bad file
    does not fail a job over many. A column missing from one of the files is
    null there. With equal (lower-cased) names the last column wins.

    LF, CR and CRLF end a record, and are kept as they are inside quotes. Files
    are split whatever they hold: where no quoted value spans lines, a line is a
    record; of other files :func:`read_records` puts the lines together. Both
    follow the same rule of what a quote opens. ``multi_line=False`` promises
    that no value spans lines and saves looking.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ConfigError("no files to read")
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        headers = list(pool.map(lambda p: read_header(spark, p), paths))
    spans = set() if multi_line is False else spanning_files(spark, paths)
    groups: dict[tuple, list[str]] = {}
    for path, header in zip(paths, headers):
        if not header:
            raise ConfigError(f"no header in {path}")
        groups.setdefault((tuple(header), qualify(spark, path) in spans), []).append(path)
    frames = [
        (read_records if spanning else _read_lines)(spark, files, header, lenient)
        for (header, spanning), files in groups.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def csv_schema(header: Sequence[str], lenient: bool) -> T.StructType:
    """One text column per position; names are put on afterwards."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(header))]
    if lenient:
        fields.append(T.StructField("_bad", T.StringType()))
    return T.StructType(fields)


def name_columns(df: DataFrame, header: Sequence[str], file: Column, row: Column) -> DataFrame:
    """Put the lower-cased header names on a positional scan."""
    last = {name.lower(): i for i, name in enumerate(header)}
    bad = [F.col("_bad").isNotNull().alias(MALFORMED)] if "_bad" in df.columns else []
    return df.select(
        *[F.col(f"c{i}").alias(name) for name, i in last.items()],
        file.alias(FILE),
        row.alias(ROW),
        *bad,
    )


def _mode(lenient: bool) -> dict[str, str]:
    if lenient:
        return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return {"mode": "FAILFAST"}


def _read_lines(spark: SparkSession, paths: list[str], header: Sequence[str], lenient: bool) -> DataFrame:
    reader = spark.read.options(**OPTIONS, **_mode(lenient)).schema(csv_schema(header, lenient))
    df = reader.csv([literal(p) for p in paths], header=True)
    return name_columns(df, header, scanned_file(), F.monotonically_increasing_id())


def _text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with what ends them: ``file``, ``at`` (order in the file), ``text``, ``end``."""
    raw = spark.read.option("lineSep", "\n").text([literal(p) for p in paths]).select(
        scanned_file().alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # A carriage return ends a line too, but not apart from its line feed.
        F.split("value", "(?<=\r)(?!$)").alias("all"),
    )
    raw = raw.select("file", "split", F.size("all").alias("parts"), F.posexplode("all").alias("part", "text"))
    last = F.col("part") == F.col("parts") - 1
    cr = F.col("text").endswith("\r")
    return raw.withColumn("line", F.monotonically_increasing_id()).select(
        "file",
        "split",
        F.struct("split", "line").alias("at"),
        F.when(cr, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")).alias("text"),
        F.when(~last, "\r").when(cr, "\r\n").otherwise("\n").alias("end"),
    )


def read_records(
    spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], lenient: bool = False
) -> DataFrame:
    """Scan CSV files whose quoted values span lines, in many tasks.

    What a line does to the state (outside or inside a quoted value) is to
    keep it, swap it, or set it, whatever it was. The state after a number of
    lines is that of the last line that sets it, swapped by the swaps since;
    so each split of a file works out its own effect, and the effects of the
    splits before it, a row for each, tell how it begins. Records are put
    together where their split lies already; only lines of those that cross
    splits are dealt once more. A file that ends inside a value is not
    grouped: it yields one malformed record.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _text_lines(spark, paths)
    opens, stays = F.col("text").rlike(OPENS), F.col("text").rlike(STAYS_OPEN)
    lines = lines.withColumns({
        "swap": (opens & ~stays).cast("int"),
        "set": F.when(opens == stays, opens.cast("int")),
        "some": F.col("text").rlike("[^\ufeff]"),
    })

    def effect(rows: DataFrame, order: str, *by: str) -> DataFrame:
        """Swaps so far and, of the last set, its state less the swaps up to it; before each row."""
        w = Window.partitionBy(*by).orderBy(order)
        rows = rows.withColumn("swaps", F.sum("swap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("base", F.last((F.col("set") + F.col("swaps")) % 2, True).over(w))
        return rows.withColumns({
            "swaps_before": F.coalesce(F.lag("swaps").over(w), F.lit(0)),
            "base_before": F.lag("base").over(w),
        })

    lines = effect(lines, "at", "file", "split")
    # The state before a line, had its split begun outside a value; or null if it depends on that.
    state = (F.col("base_before") + F.col("swaps_before")) % 2
    # For either way that a split may begin: its last record start.
    start_if = [
        F.max(F.when(F.coalesce(state, (F.lit(x) + F.col("swaps_before")) % 2) == 0, F.col("at"))).alias(f"start_if_{x}")
        for x in (0, 1)
    ]
    splits = lines.groupBy("file", "split").agg(
        (F.sum("swap") % 2).alias("swap"),
        F.max_by((F.col("base") + F.col("swaps")) % 2, "at").alias("set"),
        F.min(F.when(F.col("some"), F.col("at"))).alias("head"),  # the header is the first line that is not blank
        *start_if,
    )
    # One row for each split; a set counts from behind its split's swaps.
    splits = splits.withColumn("swap", F.when(F.col("set").isNull(), F.col("swap")).otherwise(F.lit(0)))
    splits = effect(splits, "split", "file")
    begins = (F.coalesce("base_before", F.lit(0)) + F.col("swaps_before")) % 2
    w = Window.partitionBy("file").orderBy("split")
    all_splits = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.withColumns({
        "open": begins,
        "left_open": (F.coalesce("base", F.lit(0)) + F.col("swaps")) % 2,
        "head": F.min("head").over(all_splits),
        "last": F.when(begins == 0, F.col("start_if_0")).otherwise(F.col("start_if_1")),
    })
    splits = splits.withColumns({
        "ends": F.last("left_open").over(all_splits),
        "carried": F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })

    lines = lines.join(splits.select("file", "split", "open", "left_open", "last", "carried", "ends", "head"), ["file", "split"])
    closed = lines.filter(F.col("ends") == 0).withColumn("starts", F.coalesce(state, (F.col("open") + F.col("swaps_before")) % 2) == 0)
    so_far = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.coalesce(F.max(F.when(F.col("starts"), F.col("at"))).over(so_far), F.col("carried"))
    # A record lies in its split, where all its lines are, unless it is what the split begins or ends inside of.
    crosses = (F.col("start.split") < F.col("split")) | ((F.col("left_open") == 1) & (F.col("at") >= F.col("last")))
    parts = closed.withColumn("start", started)
    inside, across = parts.filter(~crosses), parts.filter(crosses)

    def texts(parts: DataFrame, *by: str) -> DataFrame:
        """Lines put together; the line break behind a record's last line is not part of it."""
        found = parts.filter(F.col("start") > F.col("head")).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("at", "text", "end"))).alias("parts")
        )
        body = F.transform("parts", lambda x, i: F.when(i == F.size("parts") - 1, x["text"]).otherwise(F.concat(x["text"], x["end"])))
        return found.select("file", "start", F.array_join(body, "").alias("text"))

    records = texts(inside, "file", "split", "start").unionByName(texts(across, "file", "start"))
    records = records.filter(F.col("text") != "")
    schema = ", ".join(f"{f.name} string" for f in csv_schema(header, lenient))
    marked = F.replace(F.replace("text", F.lit(_MARK), F.lit(_SELF)), F.lit("\r"), F.lit(_CR))
    text = F.when(F.col("text").rlike(f"[\r{_MARK}]"), marked).otherwise(F.col("text"))
    parsed = records.select(F.from_csv(text, schema, OPTIONS | _mode(lenient)).alias("r"), "file", "start")
    values = [
        F.when(F.col(f"r.{f.name}").contains(_MARK), F.replace(F.replace(f"r.{f.name}", F.lit(_CR), F.lit("\r")), F.lit(_SELF), F.lit(_MARK)))
        .otherwise(F.col(f"r.{f.name}")).alias(f.name)
        for f in csv_schema(header, lenient)
    ]
    out = parsed.select(*values, "file", F.col("start.line").alias("line"))
    # Such a file has a line that is not blank; asking for it makes Spark deal lines once for both uses of the splits.
    unclosed = splits.filter((F.col("ends") == 1) & (F.col("split") == 0) & F.col("head").isNotNull())
    message = F.lit("a quoted value that never closes")
    nothing = [
        (message if f.name == "_bad" else F.lit(None).cast("string")).alias(f.name) for f in csv_schema(header, lenient)
    ]
    line = F.lit(0).cast("bigint")
    if not lenient:
        error = F.raise_error(F.concat(F.lit("malformed record: "), message, F.lit(" in "), F.col("file")))
        line = F.when(F.col("ends") == 1, error).cast("bigint")
    out = out.unionByName(unclosed.select(*nothing, "file", line.alias("line")))
    return name_columns(out, header, F.col("file"), F.col("line"))


def clean(df: DataFrame) -> DataFrame:
    """Lower-case the column names, trim every value, make blanks null."""
    last = {c.lower(): c for c in feed_columns(df)}
    return df.select(
        *[trim_to_null(quoted(c)).alias(name) for name, c in last.items()], *meta_columns(df)
    )


def drop_excluded(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Leave out columns by name in any case; every name must exist."""
    lower = {c.lower() for c in feed_columns(df)}
    gone = {n.lower() for n in names}
    for name in gone - lower:
        raise ConfigError(f"exclude_columns: {name!r} is not a column of the feed")
    keep = [c for c in feed_columns(df) if c.lower() not in gone]
    return df.select(*[quoted(c) for c in keep], *meta_columns(df))
