"""Operator 12: spelling variants grouped by k-d trees over letter counts.

A word is a point: how often it has each letter. One replaced letter moves the point by one up and one down, one
letter more by one up, so near words lie within a small box. For each pair of lengths (equal, or one apart)
a k-d tree of the shorter words is searched: a subtree is left out where its box is farther than that, and in
the leaves that remain the order of the letters is compared.

Spark deals the words out. A length with more words than a shard holds is cut by the upper part of a k-d tree,
built from a sample of that length; every word belongs to one shard and asks all shards that its box
reaches. The cuts decide only how even the shards are. Where a cell of equal points is still too large, its words
are dealt by hash, and whoever asks, asks all parts. Shards arrive sorted, words to search first, so that
those who ask are streamed past the tree. A word with many variants sends one partial result a batch.

Words and their forms: `occurrences` has the rule of the words, `variants` the rule of forms and roots.
Edge cases: null and empty texts have no words; a null id counts as an empty text; repeated rows count each
time; other columns are not read; without words the result is empty. Words have Latin-1 code points only, by their
rule. Memory of a task: some forty times the bytes of a piece of text (2 MB, or one longer document), and one shard of
SHARD words or SHARD_BYTES letters, whichever is less, with its counts; a word longer than that is a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, flat_text, pieces

#: Least code points of a word and least occurrences; a form has at least this many times its variant's.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: One in so many runs loses a code point.
SPOIL = 31
#: Words of a shard, and bytes where they are long.
SHARD, SHARD_BYTES = 20_000, 1 << 22
#: Sampled words a shard that cuts are made from.
SAMPLED = 32
LEAF = 24
#: Letters compared at once.
CELLS = 1 << 23

#: A letter's dimension: a to z have their own, the 64 code points from U+00C0 share six. Sharing only brings points nearer.
DIMS = 32
_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:] = 26 + np.arange(64) % 6

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and a continuation

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


# --- words --------------------------------------------------------------------------------


def crc32_runs(low: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, short: int = 64) -> np.ndarray:
    """crc32 of each byte range, carried on from `before`. Ranges up to `short` bytes go in step, others one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    n_long = int(np.count_nonzero(size > short))
    out = np.empty(len(start), np.uint32)
    for i in order[:n_long]:
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(before[i]))
    rest = order[n_long:]
    state, at = ~before[rest].astype(np.uint32), start[rest]
    left = np.searchsorted(-size[rest], -np.arange(0, short + 1), "left")  # how many are longer than j
    for j in range(int(size[rest[0]]) if len(rest) else 0):
        k = int(left[j])
        state[:k] = _CRC[(state[:k] ^ low[at[:k] + j]) & 255] ^ (state[:k] >> np.uint32(8))
    out[rest] = ~state
    return out


def words_of(buf: np.ndarray, at: np.ndarray, ids: list) -> pa.Array:
    """The words of each text, one entry for each occurrence."""
    if not len(buf):
        return pa.array([], pa.string())
    low = LOWER[buf]
    lead = buf == _LEAD
    tail = np.zeros(len(buf), bool)
    tail[1:] = lead[:-1]
    inside = _LETTER[buf] | lead | tail
    edge = np.ones(len(buf) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at[(at > 0) & (at < len(buf))]] = True
    edges = np.flatnonzero(edge)
    run = inside[edges[:-1]]
    start, end = edges[:-1][run], edges[1:][run]
    points = np.flatnonzero(inside & ~tail)
    first = np.searchsorted(points, start)
    length = np.searchsorted(points, end) - first
    doc = np.searchsorted(at, start, "right") - 1
    salt = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32_runs(low, start, end, salt[doc])
    spoiled = np.flatnonzero(h % SPOIL == 0)
    gone = points[first[spoiled] + h[spoiled] % length[spoiled]]
    keep = np.ones(len(buf), bool)
    keep[gone] = False
    wide = lead[gone]
    keep[gone[wide] + 1] = False
    size = end - start
    size[spoiled] -= 1 + wide
    length[spoiled] -= 1
    chosen = length >= LENGTH
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start[chosen]] += 1
    mark[end[chosen]] -= 1
    data = low[(np.cumsum(mark[:-1], dtype=np.int8) > 0) & keep]
    offsets = np.zeros(int(chosen.sum()) + 1, np.int64)
    np.cumsum(size[chosen], out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of all texts with at least LENGTH code points and OCCURRENCES occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, part, offsets in pieces(buf, at):
                found = words_of(part, offsets, ids[lo:hi])
                if len(found):
                    counts = pc.value_counts(found)
                    yield pa.record_batch([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


# --- points and trees ---------------------------------------------------------------------


def codes_of(words: pa.Array, length: int) -> np.ndarray:
    """Words of one length as a matrix of Latin-1 codes."""
    buf, _ = flat_text(words)
    lead = buf == _LEAD
    out = buf.copy()
    out[1:][lead[:-1]] += 0x40
    return out[~lead].reshape(-1, length)


def points_of(codes: np.ndarray) -> np.ndarray:
    """How often each word has the letters of each dimension."""
    n, length = codes.shape
    at = np.arange(n)[:, None] * DIMS + _DIM[codes]
    return np.bincount(at.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int16 if length < 1 << 15 else np.int32)


@dataclass
class Tree:
    """Boxes of nodes; an inner node has children, a leaf its number."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    members: list[np.ndarray]


def build(points: np.ndarray, size: int, tight: bool) -> Tree:
    """A tree with at most `size` points a leaf, more only where points are equal. Boxes hold the points
    (tight), or all that the cuts leave to a node."""
    low, high, left, right, dims, cuts, leaf, members = [], [], [], [], [], [], [], []
    edge = np.iinfo(points.dtype).max // 2

    def add(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        mine = points[rows]
        node = len(low)
        least, most = mine.min(0), mine.max(0)
        low.append(least if tight else lo), high.append(most if tight else hi)
        for out in (left, right, dims, cuts, leaf):
            out.append(-1)
        spread = most - least
        if len(rows) <= size or not spread.any():
            leaf[node] = len(members)
            members.append(rows)
            return node
        # the dimension whose middle value parts the rows most evenly
        best, d, cut = -1, 0, 0
        for k in np.argsort(-mine.astype(np.float32).var(0), kind="stable")[:6]:
            if spread[k]:
                middle = int(np.median(mine[:, k]))
                for c in (middle - 1, middle):
                    below = int(np.count_nonzero(mine[:, k] <= c))
                    if min(below, len(rows) - below) > best:
                        best, d, cut = min(below, len(rows) - below), int(k), c
        under = mine[:, d] <= cut
        dims[node], cuts[node] = d, cut
        below, above = hi.copy(), lo.copy()
        below[d], above[d] = cut, cut + 1
        left[node] = add(rows[under], lo, below)
        right[node] = add(rows[~under], above, hi)
        return node

    free = np.full(DIMS, edge, points.dtype)
    add(np.arange(len(points)), -free, free)
    return Tree(np.array(low), np.array(high), *(np.array(a) for a in (left, right, dims, cuts, leaf)), members)


def reach(tree: Tree, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves, each with the points that may have a partner there: the partner has in all at most `up`
    letters less than the point and at most `down` more."""
    stack = [(0, np.arange(len(asked)))]
    while stack:
        node, rows = stack.pop()
        q = asked[rows]
        near = (np.maximum(q - tree.high[node], 0).sum(1) <= up) & (np.maximum(tree.low[node] - q, 0).sum(1) <= down)
        rows = rows[near]
        if not len(rows):
            continue
        if tree.leaf[node] >= 0:
            yield int(tree.leaf[node]), rows
        else:
            stack += [(int(tree.left[node]), rows), (int(tree.right[node]), rows)]


def place(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf that each point belongs to."""
    node = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(tree.leaf[node] < 0)).size:
        at = node[inner]
        under = points[inner, tree.dim[at]] <= tree.cut[at]
        node[inner] = np.where(under, tree.left[at], tree.right[at])
    return tree.leaf[node]


def one_apart(asked: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words that differ by one replaced code point, or by one that the asking word has more."""
    n = words.shape[1]
    step = max(1, CELLS // max(1, len(words) * n))
    found = []
    for lo in range(0, len(asked), step):
        q = asked[lo : lo + step, None, :]
        if asked.shape[1] == n:
            near = (q != words).sum(2, dtype=np.int32) == 1
        else:
            front, back = q[:, :, :n] != words, q[:, :, 1:] != words
            # letters alike from the front, and where the last letter that differs from behind stands
            same = np.where(front.any(2), front.argmax(2), n)
            last = np.where(back.any(2), n - back[:, :, ::-1].argmax(2), 0)
            near = same >= last
        a, b = np.nonzero(near)
        found.append((a + lo, b))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


# --- shards -------------------------------------------------------------------------------


def shard_size(length: int) -> int:
    return max(1, min(SHARD, SHARD_BYTES // length))


def cuts(words: DataFrame) -> dict[int, tuple[Tree, list[int]]]:
    """For each length with more words than a shard holds: the upper tree, and how many parts each of its
    cells is dealt to."""
    size = F.least(F.lit(SHARD), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / F.col("length"))))
    counts = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size)
    large = {r["length"]: r["n"] for r in counts.collect()}  # lengths that fill a shard
    if not large:
        return {}
    share = {k: min(1.0, max(SAMPLED / shard_size(k), 1024 / n)) for k, n in large.items()}
    rate = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.length("word")]
    picked = words.filter((F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < rate * (1 << 30)) & F.length("word").isin(list(large)))
    sample: dict[int, list[str]] = {}
    for r in picked.select("word").collect():  # SAMPLED words a shard, at least some 1024 a length
        sample.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for length, texts in sorted(sample.items()):
        points = points_of(codes_of(pa.array(sorted(texts)), length))
        most = max(1, int(shard_size(length) * share[length]))
        tree = build(points, most, tight=False)
        out[length] = (tree, [ceil(len(m) / (2 * most)) for m in tree.members])
        tree.members = []
    return out


def dealt(words: DataFrame, trees: dict[int, tuple[Tree, list[int]]]) -> DataFrame:
    """Every word once where it is searched (role 0), and wherever it asks its own length (1) or the
    one below (2)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)  # a node for each shard

    def sent(column: pa.Array, length: int, target: int, role: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row indices with shard and part."""
        every = np.arange(len(column))
        if target not in shared.value:
            yield every, np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            return
        tree, parts = shared.value[target]
        points = points_of(codes_of(column, length))
        if role == 0:
            leaf = place(tree, points)
            hashes = np.array([zlib.crc32(w.encode()) for w in column.to_pylist()], np.int64)
            yield every, leaf, hashes % np.array(parts)[leaf]
            return
        for leaf, rows in reach(tree, points, 1, 1 if role == 1 else 0):
            for part in range(parts[leaf]):
                yield rows, np.full(len(rows), leaf), np.full(len(rows), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column("word"), batch.column("n")
            lengths = pc.utf8_length(word).to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                own = word.take(pa.array(rows))
                for role, target in ((0, length), (1, length), (2, length - 1)):
                    if target < LENGTH:
                        continue
                    for which, shard, part in sent(own, length, target, role):
                        at = pa.array(rows[which])
                        fixed = [pa.array(np.full(len(which), v, np.int32)) for v in (target, role)]
                        spread = [pa.array(v.astype(np.int32)) for v in (shard, part)]
                        yield pa.record_batch(
                            [fixed[0], *spread, fixed[1], word.take(at), n.take(at)],
                            ["length", "shard", "part", "role", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(run, "length int, shard int, part int, role int, word string, n bigint")


class Shard:
    """Words of one shard, and the tree over them."""

    def __init__(self, words: pa.Array, n: np.ndarray, length: int):
        self.words, self.n, self.length = words, n, length
        self.codes = codes_of(words, length)
        self.tree = build(points_of(self.codes), LEAF, tight=True)

    def near(self, asked: pa.Array, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (asking word, word of the shard) that are near."""
        codes = codes_of(asked, self.length + longer)
        points = points_of(codes)
        if points.dtype != self.tree.low.dtype:
            points = points.astype(np.int32)
        found = []
        for leaf, rows in reach(self.tree, points, 1, 0 if longer else 1):
            members = self.tree.members[leaf]
            a, b = one_apart(codes[rows], self.codes[members])
            found.append((rows[a], members[b]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _best(words: pa.Array, of: np.ndarray, others: pa.Array, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """For each word with partners: how many, the largest n among them, and the smallest word that has it."""
    if not len(of):
        return None
    rank = np.empty(len(others), np.int64)
    rank[pc.array_sort_indices(others.cast(pa.binary())).to_numpy()] = np.arange(len(others))
    order = np.lexsort((rank[at], -n[at], of))
    of, at = of[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    counts = np.diff(np.concatenate([first, [len(of)]]))
    best = at[first]
    return pa.record_batch(
        [words.take(pa.array(of[first])), pa.array(counts), pa.array(n[best]), others.take(pa.array(best))],
        ["word", "n_near", "best_n", "best"],
    )


def partners(sent: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: partial results of each shard and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("length", "shard", "part", "role")]
            new = np.zeros(len(batch), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            ends = [0, *np.flatnonzero(new).tolist(), len(batch)]
            for lo, hi in zip(ends[:-1], ends[1:]):
                if lo == hi:
                    continue
                *now, role = (int(c[lo]) for c in columns)
                if now != key:
                    key, held, shard = now, [], None
                part = batch.slice(lo, hi - lo)
                if role == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # nobody has this length
                if shard is None:
                    words = pa.concat_arrays([p.column("word") for p in held])
                    shard = Shard(words, np.concatenate([p.column("n").to_numpy() for p in held]), now[0])
                asked, n = part.column("word"), part.column("n").to_numpy()
                a, b = shard.near(asked, role - 1)
                out = [_best(asked, a, shard.words, shard.n, b)]
                if role == 2:
                    out.append(_best(shard.words, b, asked, n, a))
                yield from (o for o in out if o is not None)

    dealt_out = sent.repartition("length", "shard", "part").sortWithinPartitions("length", "shard", "part", "role")
    return dealt_out.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


# --- forms --------------------------------------------------------------------------------


def roots(forms: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """word, root: forms followed to the last. Every step multiplies n by RATIO, which bounds how many
    there are; each round doubles the steps taken."""
    steps = max(1, int(log10(max(most, OCCURRENCES) / OCCURRENCES) / log10(RATIO)) + 1)
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = scratch.stage(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their counts."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.stage(words.select("word", "n"), "words")
    found = partners(dealt(words, cuts(words)))
    # the largest n first, then the smallest word
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("top.less") >= F.col("n") * RATIO
    near = scratch.stage(
        joined.select(
            "word",
            F.when(is_form, F.col("top.best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, -F.col("top.less")).alias("form_n"),
        ),
        "near",
    )
    most = near.agg(F.max("n")).first()[0] or 0
    last = roots(near.filter("form IS NOT NULL").select("word", "form"), most, scratch)
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of all texts."""
    return variants(occurrences(docs))
