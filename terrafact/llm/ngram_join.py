"""Operator 5: n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, ordered by rarity. Two sets with Jaccard t
share at least ceil(t * n) tokens, so with a prefix of n - ceil(t * n) + l tokens they share at
least l tokens of their prefixes. Each document chooses its own l from 1 to `MOST`: a longer prefix has more
tokens to look up but asks for more of them to be shared; the choice is the l for which
looking up plus verifying the expected candidates is cheapest, by the counts of the token buckets.
Two documents are verified if they share min(l, l') prefix tokens and lengths and positions allow
the overlap. What the sets' parity maps also leave possible is verified by counting the shingles of both
whole texts.

Steps:
1. Equal sets are a class; the rest works on one document of each (copies cost one row).
2. Min-hash groups: each class is verified against its group's most common member, the one whose
   tokens have the highest mean level: among near copies that is their source, which they all link with
   even where they don't with each other. What links is one component. This settles large groups of near copies in a
   linear number of pairs. Members that are not in one component with all others by then are compared with up to LEADS more
   members of each group. None of this is needed for completeness: it only names pairs that step 3 need not look at.
3. Prefix join of all classes that aren't in one component yet, under filters of length, of position and of folded
   parity maps, verification, components again.
So every link between different components is found, and no list of all pairs of a group is made.

Edge cases: null or empty texts and texts without words have no shingles, n_shingles 0, and link
with nothing; texts of fewer words than k have their whole sequence as one shingle; rows with a null id
get component null and link with nothing; rows that repeat an id are rows of their own, and
component_id is the smallest id among all rows reached; an empty table gives no rows. Classes have 64-bit names: two different sets out
of n share one with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import setjoin as S
from .common import Scratch, flat_text, list_column, pieces, shingles, unused, word_hashes
from .components import connected

MOST = 4
#: Cost of verifying a candidate, in prefix tokens looked up.
VERIFY = 200
GROUPS = 3
#: Further members of a min-hash group that those outside their component are compared with, at most.
LEADS = 16
#: 64-bit words of the parity maps that candidates are compared by before their texts are.
MAP = 32
#: 64-bit words that a posting has of the map, folded. They tell little of sets of more than some 300 tokens.
FOLD = 2
#: Bits for a position in a posting.
PLACE = 29
#: Classes whose texts are fetched are marked in so many buckets.
BUCKETS = 1 << 20


def tokens_of(k: int) -> S.Tokens:
    def run(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, _, first = word_hashes(buf, at)
        h, owner = shingles(words, first, k)
        if len(owner) and (np.diff(owner) < 0).any():  # short texts come last
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
        return h, np.searchsorted(owner, np.arange(len(at)))

    return run


def matches_needed(numbers: np.ndarray, sizes: np.ndarray, need: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The l of each set. expected: other documents with a token, by level."""
    extra = expected[(numbers >> np.uint64(S.HASH_BITS)).astype(np.int64)]
    sums = np.concatenate([[0.0], np.cumsum(extra)])
    start = np.cumsum(sizes) - sizes
    best, cost = np.ones(len(sizes), np.int64), np.full(len(sizes), np.inf)
    for m in range(1, MOST + 1):
        size = np.minimum(sizes - need + m, sizes)
        hits = sums[start + size] - sums[start]
        now = np.where(m <= np.maximum(need, 1), size + hits + VERIFY * hits / m, np.inf)
        better = now < cost * (1 - 1e-9)
        best[better], cost[better] = m, now[better]
    return best


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, th (hash of the text), n, cls, l, prefix, and min-hashes of each row."""
    tokens = tokens_of(k)
    counts = S.count_buckets(docs, tokens)
    levels = S.levels_of(counts)
    mean = max(1.0, float(counts.mean()))
    expected = np.maximum(0.0, 2 ** (np.arange(S.LEVELS) / 2) - 2 * mean)
    shared = docs.sparkSession.sparkContext.broadcast((levels, expected))  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, expected = shared.value
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            for lo, hi, part, offsets in pieces(buf, at):
                numbers, n = S.ordered_sets(*tokens(part, offsets), levels)
                need = S.least_overlap(n, num, den)
                matches = matches_needed(numbers, n, need, expected)
                prefix, length = S.head(numbers, n, n - need + matches)
                yield pa.record_batch(
                    [
                        batch.column("doc_id")[lo:hi], batch.column("th")[lo:hi], pa.array(n),
                        pa.array(S.fingerprints(numbers, n)), pa.array(matches),
                        list_column(prefix.view(np.int64), length, pa.int64()),
                        list_column(S.parity_maps(numbers, n, MAP).ravel(), np.full(hi - lo, MAP), pa.int64()),
                        pa.array(S.reduced(np.add, numbers >> np.uint64(S.HASH_BITS), n) / np.maximum(n, 1)),
                        *[pa.array(h) for h in S.min_hashes(numbers, n, GROUPS)],
                    ],
                    ["doc_id", "th", "n", "cls", "l", "prefix", "map", "common", *[f"m{j}" for j in range(GROUPS)]],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    mins = ", ".join(f"m{j} bigint" for j in range(GROUPS))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, f"doc_id {kind}, th bigint, n bigint, cls bigint, l bigint, prefix array<bigint>, map array<bigint>, common double, {mins}"
    )


def texts_of(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, text of the classes that stand in pairs. Buckets of what is wanted, at most BUCKETS
    numbers, go to all tasks, so that few other texts are shuffled."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rows = scratch.stage(classes.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")).join(needed, "cls"), "wanted")
    bucket = F.pmod("th", F.lit(BUCKETS))
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).withColumn("bucket", bucket)
    few = marked.join(F.broadcast(rows.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")
    # Rows that repeat stand for one text: they lie together after the join, and one is kept.
    one = few.join(rows, ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "cls"])
    return scratch.stage(one.select("cls", "text"), "texts")


def close(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the parity maps of both sets leave possible."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("map").alias("map_a"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("map").alias("map_b"))
    _, need = allowed("na", "nb", num, den)
    differ = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").filter(differ <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def allowed(na: Column | str, nb: Column | str, num: int, den: int) -> tuple[Column, Column]:
    """Whether two sizes can reach the threshold, and the overlap that they then need."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (na, nb))
    return (den * a >= num * b) & (den * b >= num * a), F.ceil((a + b) * num / F.lit(float(num + den)) - 1e-9)


def shared_tokens(classes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, rest, need, matches for each token that the prefixes of two classes of different roots share, as far as
    sizes, positions and folded parity maps allow the threshold. Each pair that reaches it has `matches` such rows or more.

    In a large group of near copies those who are too far from the rest share tokens with all of it; the maps, which
    each posting brings along, leave few of these pairs, so what leaves the join doesn't grow with the square of a group."""
    bits = [reduce(Column.bitwiseXOR, [F.col("map")[i] for i in range(j, MAP, FOLD)]).alias(f"bits{j}") for j in range(FOLD)]
    size = F.shiftleft("n", PLACE + 3) + F.shiftleft("l", PLACE)  # and the position, in one number
    posting = (
        classes.select("cls", "root", F.col("prefix")[0].alias("least"), *bits, size.alias("size"), F.posexplode("prefix").alias("pos", "token"))
        .select("token", "cls", "root", "least", *[f"bits{j}" for j in range(FOLD)], (F.col("size") + F.col("pos")).alias("at"))
    )
    a, b = posting.alias("x"), posting.alias("y")

    def parts(side: str) -> tuple[Column, Column, Column]:
        at = F.col(f"{side}.at")
        return F.shiftright(at, PLACE + 3), F.shiftright(at, PLACE).bitwiseAND(F.lit(7)), at.bitwiseAND(F.lit((1 << PLACE) - 1))

    (nx, lx, px), (ny, ly, py) = parts("x"), parts("y")
    fits, need = allowed(nx, ny, num, den)
    # Of a link the m-th shared token leaves at most m - 1 + rest in common, and the first `matches` tell
    # all. Where one is enough and both sets begin with the same token, that token is it.
    rest, matches = F.least(nx - px, ny - py), F.least(lx, ly)
    one = (matches > 1) | (F.col("x.least") != F.col("y.least")) | (F.col("x.token") == F.col("x.least"))
    differ = sum((F.bit_count(F.col(f"x.bits{j}").bitwiseXOR(F.col(f"y.bits{j}"))) for j in range(FOLD)), F.lit(0))
    met = a.join(
        b,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
        & fits & (rest + matches - 1 >= need) & one & (differ <= nx + ny - 2 * need),
    )
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), rest.alias("rest"), need.alias("need"), matches.alias("matches"))


def similarity_classes(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, th, n_shingles, component_id, stays (whether it is the first of its component) for each
    row of docs (doc_id, text); links at Jaccard num/den or more."""
    scratch = Scratch(docs.sparkSession, "ngram")
    tokens = tokens_of(k)
    rows = scratch.stage(signatures(docs, k, num, den), "signatures")
    classes = scratch.stage(
        rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(
            F.min(F.struct("doc_id", "th")).alias("rep"),
            *[F.first(c).alias(c) for c in ("n", "l", "prefix", "map", "common", *[f"m{j}" for j in range(GROUPS)])],
        ),
        "classes",
    )

    # Step 2: each class and the first of its min-hash groups.
    member = classes.select(
        "cls", "n", "common",
        F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("m")) for j in range(GROUPS)])).alias("g"),
    ).select("cls", "n", "common", F.xxhash64("g.j", "g.m").alias("g"))
    lead = member.groupBy("g").agg(F.max_by("cls", "common").alias("lead"), F.max_by("n", "common").alias("lead_n"))
    fits, _ = allowed("n", "lead_n", num, den)
    star = (
        member.join(lead, "g").filter(fits & (F.col("cls") != F.col("lead")))
        .select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    )
    star = scratch.stage(close(star, classes, num, den), "star")
    texts = texts_of(scratch, docs, classes, star)
    links = scratch.stage(S.verified(star, texts, tokens, num, den), "links")
    scratch.drop(texts)
    known = connected(scratch, links).withColumnRenamed("v", "cls")

    # Once more, with several members of each group that is not one component yet.
    placed = member.join(known, "cls", "left").select("cls", "n", "common", "g", F.coalesce("root", "cls").alias("root"))
    split = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("g")
    placed = scratch.stage(placed.join(split, "g"), "placed")
    part = F.pmod(F.xxhash64("g", "cls"), F.lit(LEADS)).alias("part")
    leads = placed.groupBy("g", part).agg(*[F.max_by(c, F.struct("common", "cls")).alias(f"lead_{c}") for c in ("cls", "n", "root")])
    fits, _ = allowed("n", "lead_n", num, den)
    again = (
        placed.join(leads.drop("part"), "g").filter(fits & (F.col("root") != F.col("lead_root")))
        .select(F.least("cls", "lead_cls").alias("a"), F.greatest("cls", "lead_cls").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    )
    again = scratch.stage(close(again, classes, num, den), "star-again")
    texts = texts_of(scratch, docs, classes, again)
    links = scratch.stage(links.unionByName(S.verified(again, texts, tokens, num, den)), "links-again")
    scratch.drop(texts, placed)
    known = connected(scratch, links).withColumnRenamed("v", "cls")

    # Step 3: prefixes of all classes; only pairs of two components are of interest.
    met = shared_tokens(classes.join(known, "cls", "left").withColumn("root", F.coalesce("root", "cls")), num, den)
    pairs = (
        met.groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("shared"), F.max("rest").alias("rest"), F.max("need").alias("need"), F.max("matches").alias("matches")
        ).filter("shared >= matches AND rest >= need").select("a", "b")
    )
    pairs = scratch.stage(close(pairs, classes, num, den), "pairs")
    texts = texts_of(scratch, docs, classes, pairs)
    more = S.verified(pairs, texts, tokens, num, den)
    labels = connected(scratch, links.unionByName(more)).withColumnRenamed("v", "cls")
    scratch.drop(texts)
    rooted = classes.select("cls", "rep").join(labels, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    found = scratch.stage(rooted.join(least, "root").select("cls", "least"), "components")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return (
        rows.select("doc_id", "th", "n", "cls").join(found, "cls", "left")
        .select(
            "doc_id", "th", F.col("n").alias("n_shingles"),
            F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(linked, F.struct("doc_id", "th") == F.col("least")).otherwise(F.lit(True)).alias("stays"),
        )
    )


def first_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, without those that reach a smaller one by links: of
    each component the row with the smallest (doc_id, text hash) stays, once. Rows without words
    or id stay all; columns of any other names stay as they are."""
    judged = similarity_classes(docs, k, num, den)
    id_, th, nth = unused(docs, "id", "th", "copy")
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    gone = judged.filter("NOT stays").select(number.alias(id_), F.col("th").alias(th)).distinct()
    left = docs.withColumns({id_: number, th: F.xxhash64("text")}).join(gone, [id_, th], "left_anti")
    copy = F.row_number().over(Window.partitionBy(id_, th).orderBy(id_))  # of rows equal in id and text
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.withColumn(nth, F.when(alone, F.lit(1)).otherwise(copy)).filter(F.col(nth) == 1).select(*docs.columns)
