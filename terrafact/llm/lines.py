"""Operator 6: line dedup by an exact set-similarity join.

A line is the set of its words (A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`), ordered by rarity in
the corpus. A line is removed if an earlier line has Jaccard num/den or more with it; earlier is by
(doc_id, text hash, line number), judged on the input, so the result doesn't depend on order
of work.

1. Lines with equal sets are a class; all but its first are removed. The rest works on classes.
2. Min-hash groups: each class is compared by parity map with up to LEADS early classes of its groups, and
   verified against the closest earlier one. A class that matches an earlier one is settled; large groups of
   similar lines take a linear number of pairs. This only saves work in step 3.
3. Prefix join: two similar sets share a token in their prefixes of n - ceil(t * n) + 1. Classes of
   which one isn't settled are joined under filters of length, of position, and of a parity map of
   the tokens (bits that differ are at most the tokens that differ). Pairs whose later class is settled go.
   What passes is verified on the lines' texts: for each class first the closest earlier one; only
   classes that it doesn't settle meet the others. The later of two similar classes goes.

A class is named by a 64-bit hash of all bits of its words' hashes, since nothing compares the members of a
class again. A posting is the token, the class, its size and position, and 64 bits of its parity map.

Edge cases: null texts count as empty; a text has one line more than line breaks; lines without words
match nothing and stay; rows of one id and equal text are the same place, so neither removes the
other's lines; ids are whole numbers, and a null id comes before all others; an empty table gives no rows; columns of any other names stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin as S
from .common import Scratch, flat_text, list_column, mix, pieces, unused, word_hashes
from .ngram_join import BUCKETS, allowed

BITS = 19
GROUPS = 2
#: Early classes of a min-hash group that its members are compared with, at most.
LEADS = 4
#: 64-bit words of the parity maps that candidates are compared by before their texts are.
MAP = 4
#: Bits for a position in a posting.
PLACE = 24
NUM, DEN = 4, 5
#: Bytes of text worked on at once; arrays of lines and words take some hundred times as much.
PIECE = 1 << 19


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, first = word_hashes(buf, at)
    return h, first


def line_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines start (and the end of all), and the text of each; a line holds its line break."""
    breaks = np.flatnonzero(buf == 10)
    owner = np.searchsorted(at, breaks, "right") - 1
    start = np.concatenate([at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(at) - 1), owner])
    order = np.lexsort((start, doc))
    return np.append(start[order], at[-1]), doc[order]


def names(h: np.ndarray, first: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of sets of words: fingerprints of the numbers, which have the upper 48 bits of each
    hash, with fingerprints of the lower 48 bits."""
    low, lows = S.ordered_sets(h << np.uint64(64 - S.HASH_BITS), first, np.zeros(2, np.uint8))
    both = S.fingerprints(low, lows).view(np.uint64)
    return mix(S.fingerprints(numbers, sizes).view(np.uint64) + mix(both)).view(np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    """id (null as the smallest), th, text of documents."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"),
    )


def line_sets(src: DataFrame) -> DataFrame:
    """One row for each line with words: id, th, line, n, cls, min-hashes, prefix. Of equal sets in a
    batch only one row has the prefix."""
    levels = S.levels_of(S.count_buckets(src, tokens, BITS, PIECE))
    shared = src.sparkSession.sparkContext.broadcast(levels)  # 2**BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            seen: set[int] = set()
            for lo, hi, part, offsets in pieces(buf, at, PIECE):
                starts, doc = line_spans(part, offsets)
                h, first_word = tokens(part, starts)
                numbers, n = S.ordered_sets(h, first_word, levels)
                cls = names(h, first_word, numbers, n)
                here, first = np.unique(cls, return_index=True)
                one = np.zeros(len(n), bool)
                one[first[[c not in seen for c in here.tolist()]]] = True
                seen.update(here.tolist())
                prefix, length = S.head(numbers, n, np.where(one, n - S.least_overlap(n, NUM, DEN) + 1, 0))
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                rows = pa.record_batch(
                    [
                        batch.column("id")[lo:hi].take(pa.array(doc)), batch.column("th")[lo:hi].take(pa.array(doc)),
                        pa.array(number), pa.array(n), pa.array(cls),
                        *[pa.array(h) for h in S.min_hashes(numbers, n, GROUPS)],
                        *[pa.array(m) for m in S.parity_maps(numbers, n, MAP).T.copy()],
                        list_column(prefix.view(np.int64), length, pa.int64()),
                    ],
                    ["id", "th", "line", "n", "cls", *[f"m{j}" for j in range(GROUPS)], *[f"p{j}" for j in range(MAP)], "prefix"],
                )
                yield rows.filter(pa.array(n > 0))

    mins = ", ".join([f"m{j} bigint" for j in range(GROUPS)] + [f"p{j} bigint" for j in range(MAP)])
    return src.mapInArrow(run, f"id bigint, th bigint, line bigint, n bigint, cls bigint, {mins}, prefix array<bigint>")


def texts_of(scratch: Scratch, src: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, text of the first line of each class that stands in pairs."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = classes.select("cls", "first.*").join(needed, "cls").groupBy("id", "th").agg(
        F.collect_list(F.struct("line", "cls")).alias("lines")  # lines of one text
    )
    wanted = scratch.stage(wanted, "wanted")
    bucket = F.pmod("th", F.lit(BUCKETS))  # marks which texts are wanted; at most BUCKETS numbers go to all tasks
    few = src.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    # Rows that repeat stand for one text: they lie together after the join, and one is kept.
    one = few.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])
    rows = one.select(F.explode("lines").alias("x"), F.split("text", "\n").alias("all"))
    return scratch.stage(rows.select("x.cls", F.element_at("all", (F.col("x.line") + 1).cast("int")).alias("text")), "texts")


def folded_map() -> Column:
    """The parity map of a class in 64 bits."""
    return reduce(Column.bitwiseXOR, [F.col(f"p{j}") for j in range(MAP)]).alias("bits")


def close(a: Column, na: Column, b: Column, nb: Column) -> tuple[Column, Column]:
    """Whether sizes and folded parity maps of two classes allow the threshold; the overlap needed."""
    fits, need = allowed(na, nb, NUM, DEN)
    return fits & (F.bit_count(a.bitwiseXOR(b)) <= na + nb - 2 * need), need


def similar_lines(docs: DataFrame) -> DataFrame:
    """id, th, line of the lines to remove."""
    scratch = Scratch(docs.sparkSession, "lines")
    src = prepared(docs)
    sets = scratch.stage(line_sets(src), "sets")
    mins = [F.any_value(c).alias(c) for c in ("n", *[f"m{j}" for j in range(GROUPS)], *[f"p{j}" for j in range(MAP)])]
    prefix = F.first(F.when(F.size("prefix") > 0, F.col("prefix")), True).alias("prefix")
    classes = scratch.stage(
        sets.groupBy("cls").agg(F.min(F.struct("id", "th", "line")).alias("first"), *mins, prefix), "classes"
    )
    lines = scratch.stage(sets.select("id", "th", "line", "cls"), "lines")
    scratch.drop(sets)  # what else it has, classes have

    member = classes.select(
        "cls", "n", folded_map(), F.col("first.id").alias("id"),
        F.explode(F.array(*[F.xxhash64(F.lit(j), F.col(f"m{j}")) for j in range(GROUPS)])).alias("g"),
    )
    lead = member.groupBy("g", F.pmod("cls", F.lit(LEADS)).alias("part")).agg(*[F.min_by(c, "id").alias(f"lead_{c}") for c in ("cls", "n", "bits")])
    fits, _ = close(F.col("bits"), F.col("n"), F.col("lead_bits"), F.col("lead_n"))
    star = scratch.stage(
        member.join(lead.drop("part"), "g").filter((F.col("cls") != F.col("lead_cls")) & fits)
        .select(F.col("cls").alias("a"), F.col("lead_cls").alias("b")).distinct(),
        "star",
    )

    def possible(pairs: DataFrame, name: str, settled: DataFrame | None = None) -> DataFrame:
        """Pairs that the wider parity maps of both classes leave, as the earlier class, the later one and the bits
        that differ, without those whose later class is settled."""

        def side(c: str) -> DataFrame:
            maps = [F.col(f"p{j}").alias(f"p{j}_{c}") for j in range(MAP)]
            return classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("first").alias(f"first_{c}"), *maps)

        _, need = allowed("n_a", "n_b", NUM, DEN)
        differ = sum((F.bit_count(F.col(f"p{j}_a").bitwiseXOR(F.col(f"p{j}_b"))) for j in range(MAP)), F.lit(0))
        left = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", differ).filter(F.col("differ") <= F.col("n_a") + F.col("n_b") - 2 * need)
        swap = F.col("first_b") < F.col("first_a")
        left = left.select(
            F.when(swap, F.col("b")).otherwise(F.col("a")).alias("earlier"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("later"), "differ"
        )
        if settled is not None:
            left = left.join(settled.select(F.col("cls").alias("later")), "later", "left_anti")
        out = scratch.stage(left.select("earlier", "later", "differ"), name)
        scratch.drop(pairs)
        return out

    def closest(pairs: DataFrame) -> DataFrame:
        """Of each later class the earlier one with the fewest bits that differ."""
        return pairs.groupBy(F.col("later").alias("b")).agg(F.min(F.struct("differ", F.col("earlier").alias("a"))).alias("best")).select("best.a", "b")

    def verify(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        """The later classes of pairs that are similar."""
        return scratch.stage(S.verified(pairs, texts, tokens, NUM, DEN).select(F.col("b").alias("cls")).distinct(), name)

    star = possible(star, "star-possible")
    tried = scratch.stage(closest(star), "star-closest")
    texts = texts_of(scratch, src, classes, tried)
    settled = verify(tried, texts, "settled")
    scratch.drop(star, texts, tried)
    # size, whether settled, and position in one number
    size = F.shiftleft("n", PLACE + 1) + F.when(F.col("settled"), F.lit(1 << PLACE)).otherwise(F.lit(0))
    posting = (
        classes.join(settled.withColumn("settled", F.lit(True)), "cls", "left")
        .select("cls", folded_map(), size.cast("bigint").alias("size"), F.posexplode("prefix").alias("pos", "token"))
        .select("token", "cls", "bits", (F.col("size") + F.col("pos")).alias("at"))
    )
    x, y = posting.alias("x"), posting.alias("y")

    def parts(side: str) -> tuple[Column, Column, Column]:
        at = F.col(f"{side}.at")
        return F.shiftright(at, PLACE + 1), at.bitwiseAND(F.lit((1 << PLACE) - 1)), at.bitwiseAND(F.lit(1 << PLACE)) != 0

    (nx, px, done_x), (ny, py, done_y) = parts("x"), parts("y")
    fits, need = close(F.col("x.bits"), nx, F.col("y.bits"), ny)
    pairs = scratch.stage(
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & ~(done_x & done_y) & fits & (F.least(nx - px, ny - py) >= need))
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(),
        "pairs",
    )
    pairs = possible(pairs, "pairs-possible", settled)
    texts = texts_of(scratch, src, classes, pairs.select(F.col("earlier").alias("a"), F.col("later").alias("b")))
    tried = scratch.stage(closest(pairs), "closest")
    found = verify(tried, texts, "found")
    others = pairs.select(F.col("earlier").alias("a"), F.col("later").alias("b")).join(tried, ["a", "b"], "left_anti")
    more = verify(others.join(found.withColumnRenamed("cls", "b"), "b", "left_anti").select("a", "b"), texts, "found-more")
    scratch.drop(pairs, texts, tried)
    gone = settled.unionByName(found).unionByName(more).distinct().withColumn("gone", F.lit(True))
    judged = classes.select("cls", "first").join(gone, "cls", "left")
    marked = lines.select("id", "th", "line", "cls").join(judged, "cls")
    # a class that matches nothing earlier keeps its first line
    return marked.filter("gone OR id <> first.id OR th <> first.th OR line <> first.line").select("id", "th", "line").distinct()


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-separated) of each row."""
    gone = similar_lines(docs).groupBy("id", "th").agg(F.sort_array(F.collect_list("line")).alias("gone"))  # lines of one text
    rows = prepared(docs).select("id", "th", (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("n_lines"))
    kind = docs.schema["doc_id"].dataType
    return rows.join(gone, ["id", "th"], "left").select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).cast(kind).alias("doc_id"), "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, with the lines left as `text`; a document all of whose lines are removed goes.
    A null text stays null."""
    id_, th, gone_, kept_ = unused(docs, "id", "th", "gone", "kept")
    gone = similar_lines(docs).groupBy(F.col("id").alias(id_), F.col("th").alias(th)).agg(F.collect_set("line").alias(gone_))
    keyed = docs.withColumns({
        id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))),
        th: F.xxhash64(F.coalesce("text", F.lit(""))),
    })
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone_, i.cast("bigint")))
    cut = keyed.join(gone, [id_, th], "left").withColumn(kept_, F.when(F.col(gone_).isNotNull(), kept))
    return (
        cut.filter(F.col(kept_).isNull() | (F.size(kept_) > 0))
        .withColumn("text", F.coalesce(F.array_join(kept_, "\n"), F.col("text"))).select(*docs.columns)
    )


#: The same join as SQL, over distinct word sets, with a prefix by frequency.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i AS line, string_split(coalesce(text, ''), chr(10))[i + 1] AS body
  FROM documents, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS r(i)),
folded AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(
    translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'))) AS words FROM lines),
sets AS (SELECT words, len(words) AS n, min((doc_id, line)) AS first, row_number() OVER () AS cls FROM folded WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT cls, n, first, unnest(words) AS w FROM sets),
df AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
ranked AS (SELECT cls, n, first, w, row_number() OVER (PARTITION BY cls ORDER BY c, w) AS r FROM tokens JOIN df USING (w)),
prefix AS (SELECT * FROM ranked WHERE r <= n - ceil({NUM} * n / {DEN}.0) + 1),
pairs AS (SELECT DISTINCT x.cls AS a, y.cls AS b FROM prefix x JOIN prefix y ON x.w = y.w AND x.first < y.first
          AND {DEN} * x.n >= {NUM} * y.n AND {DEN} * y.n >= {NUM} * x.n),
gone AS (SELECT DISTINCT b AS cls FROM pairs JOIN sets x ON x.cls = a JOIN sets y ON y.cls = b
         WHERE len(list_intersect(x.words, y.words)) * {NUM + DEN} >= {NUM} * (x.n + y.n)),
removed AS (SELECT f.doc_id, f.line FROM folded f JOIN sets s ON f.words = s.words LEFT JOIN gone g ON g.cls = s.cls
            WHERE g.cls IS NOT NULL OR (f.doc_id, f.line) <> s.first)
SELECT l.doc_id, count(*) AS n_lines, count(r.line) AS n_removed, coalesce(string_agg(CAST(r.line AS VARCHAR), ',' ORDER BY r.line), '') AS removed_lines
FROM lines l LEFT JOIN removed r USING (doc_id, line) GROUP BY l.doc_id
"""
