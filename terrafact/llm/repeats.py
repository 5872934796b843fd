"""Operator 9: removal of repeated byte strings with a run-length index.

Every byte that a string of `LENGTH` bytes covers which also starts earlier (smaller doc_id, or
same document, earlier start) is removed, judged on the input. Steps:

1. Anchors. In each window of LENGTH bytes the least of its GRAM-byte strings is its anchor, least
   by rarity in the corpus (counts of hash buckets), then by hash. Equal windows have equal anchors at equal
   places, so equal windows can only be found among the occurrences of one anchor. A run of
   windows with one anchor occurrence is a snippet; rare anchors keep what surrounds a common
   passage out of the passage's groups.
2. Anchors that occur once are done. Of the others, equal snippets are a class: all windows of
   later members repeat those of the first.
3. First members meet by anchor. Of each group of anchors a run-compressed Burrows-Wheeler transform
   is built over its snippets in corpus order; runs end where the character changes or where
   neighbouring rows agree in fewer than LENGTH bytes, and carry as their sample the earliest (doc_id, start)
   among their rows. All snippets are streamed backwards through the index, many at a time; as soon as
   a match is LENGTH long, the sample says whether an earlier place has it.
4. The windows found are turned into bytes of each document.

An index covers about `INDEX_BYTES` of snippets: anchors are independent of each other, so a task
builds one index after another and holds one at a time.

Edge cases: null counts as empty; texts shorter than LENGTH lose nothing; rows with a null id take no part and lose
nothing; in rows that repeat an id, equal starts are not earlier than each other; long
texts are cut into overlapping segments for step 1; an empty table gives no rows. Snippets and anchors are
compared by 64-bit hashes in steps 1 and 2, by bytes in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin as S
from .common import PIECE_BYTES, Scratch, flat_text, pieces, prefix_hash, range_hash, unused

LENGTH = 100
GRAM = 24
#: Snippet bytes that one index covers, about.
INDEX_BYTES = 1 << 18
_PLACE = 28
#: Bits for a start in a text, which is below 2**31.
_START = 32


# --- step 1: anchors -----------------------------------------------------------------------


def gram_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM-byte strings at all places, and the sums behind them."""
    sums = prefix_hash(buf)
    at = np.arange(max(0, len(buf) - GRAM + 1))
    return range_hash(sums, at, at + GRAM), sums


def all_grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gram_hashes(buf)[0], at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w values: the end of one block and the beginning of the next."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def snippets(buf: np.ndarray, at: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all snippets of texts laid end to end: text index, start in the buffer, windows, hash of
    the anchor, hash of the bytes."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none, none
    h, sums = gram_hashes(buf)
    bits = int(levels.size).bit_length() - 1
    level = levels[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    order = (level << np.uint64(58)) | ((h >> np.uint64(6 + _PLACE)) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(order, LENGTH - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    # windows inside one text
    size = np.maximum(np.diff(at) - LENGTH + 1, 0)
    window = np.arange(int(size.sum())) + np.repeat(at[:-1] - (np.cumsum(size) - size), size)
    doc = np.repeat(np.arange(len(size)), size)
    if not len(window):
        return none, none, none, none, none
    place = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start = window[first]
    bytes_hash = range_hash(sums, start, start + count + LENGTH - 1)
    return doc[first], start, count, h[place[first]].view(np.int64), bytes_hash.view(np.int64)


def segments(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, bytes, offsets, and where each part starts in its text; windows of a long text
    are split among segments that overlap."""
    for lo, hi, part, offsets in pieces(buf, at):
        if hi - lo > 1 or len(part) <= 2 * PIECE_BYTES:
            yield np.arange(lo, hi), part, offsets, np.zeros(hi - lo, np.int64)
            continue
        for begin in range(0, max(1, len(part) - LENGTH + 1), PIECE_BYTES):
            piece = part[begin : begin + PIECE_BYTES + LENGTH - 1]
            yield np.array([lo]), piece, np.array([0, len(piece)]), np.array([begin])


def anchors(docs: DataFrame) -> DataFrame:
    """f (anchor), c (snippet), id, at (start * 128 + windows) of all snippets."""
    levels = S.levels_of(S.count_buckets(docs, all_grams))
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            buf, at = flat_text(batch.column("text"))
            for rows, part, offsets, begin in segments(buf, at):
                doc, start, count, f, c = snippets(part, offsets, levels)
                yield pa.record_batch(
                    [pa.array(f), pa.array(c), pa.array(ids[rows][doc], pa.int64()), pa.array((start - offsets[doc] + begin[doc]) * 128 + count)],
                    ["f", "c", "id", "at"],
                )

    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    return known.mapInArrow(run, "f bigint, c bigint, id bigint, at bigint")


# --- step 3: the index -----------------------------------------------------------------------


class RunLengthIndex:
    """The run-compressed transform of some texts (each of LENGTH bytes or more), in corpus order;
    owner and begin: of each text the number of its document, in corpus order, and where it starts there."""

    def __init__(self, texts: list[bytes], owner: np.ndarray, begin: np.ndarray):
        self.n = len(texts)
        self.size = np.array([len(t) for t in texts])
        ends = np.cumsum(self.size + 1) - 1  # places of the end marks
        self.start = ends - self.size
        symbols = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        left = np.repeat(ends, self.size + 1) - np.arange(len(symbols))  # bytes before the end mark
        # Earlier is by document and start there: rows that share an id have snippets that overlap.
        self.place = np.repeat((owner << _START) + begin - self.start, self.size + 1) + np.arange(len(symbols))
        rows, same = self._sort(symbols, left)
        before = symbols[rows - 1]
        before[rows == 0] = 0
        before[np.isin(rows, self.start)] = 0
        # runs, and for each the place of its first row's LF step
        edge = np.ones(len(rows), bool)
        edge[1:] = (before[1:] != before[:-1]) | ~same[1:]
        self.run_start = np.flatnonzero(edge)
        length = np.diff(np.append(self.run_start, len(rows)))
        char = before[self.run_start]
        by_char = np.argsort(char, kind="stable")
        self.run_to = np.empty(len(char), np.int64)
        self.run_to[by_char] = np.cumsum(length[by_char]) - length[by_char]
        self.run_char = char
        # samples: the earliest place of each run, then of all runs that agree in LENGTH bytes
        least = np.minimum.reduceat(self.place[rows], self.run_start)
        group = np.cumsum(~same[self.run_start]) - 1
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        self.sample = np.minimum.reduceat(least, heads)[group]

    @staticmethod
    def _sort(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order (up to their end marks, then by place), and whether each agrees
        with the one before in LENGTH bytes."""
        n = len(symbols)
        first = np.zeros(n, np.int64)
        for j in range(7):
            part = np.zeros(n, np.int64)
            part[: n - j] = symbols[j:]
            first = first << 9 | np.where(left >= j, part, 0)
        rows = np.argsort(first, kind="stable")
        # A suffix's rank is the row where those begin that agree with it so far.
        new = np.ones(n, bool)
        ordered = first[rows]
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[rows] = np.flatnonzero(new)[np.cumsum(new) - 1]
        known, half = 7, None
        most = int(left.max()) + 1
        while True:
            if known < LENGTH <= 2 * known:
                half = (rank.copy(), known)
            # only rows whose rank is shared, and whose texts go on, can change
            shared = np.zeros(n, bool)
            shared[:-1] = ~new[1:]
            shared |= ~new
            at = np.flatnonzero(shared)
            if known >= most or not len(at):
                break
            here = rows[at]
            after = np.where(left[here] < known, 0, rank[np.minimum(here + known, n - 1)] + 1)
            order = np.argsort(rank[here] * (n + 1) + after, kind="stable")
            here, after = here[order], after[order]
            old = rank[here]
            rows[at] = here
            split = np.ones(len(at), bool)
            split[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
            new[at] = split
            rank[here] = at[np.flatnonzero(split)[np.cumsum(split) - 1]]
            known *= 2
        if half is None:  # all suffixes differ before LENGTH bytes
            half = (rank, LENGTH)
        short, known = half
        far = np.minimum(np.arange(n) + LENGTH - known, n - 1)
        key = np.where(left >= LENGTH, short * (n + 1) + short[far], -1 - np.arange(n))[rows]
        same = np.zeros(n, bool)
        same[1:] = key[1:] == key[:-1]
        return rows, same

    def matches(self) -> list[np.ndarray]:
        """For each text, whether each of its windows of LENGTH bytes has an earlier place. All texts go
        backwards through the transform together, one byte a step."""
        out = [np.zeros(max(0, s - LENGTH + 1), bool) for s in self.size]
        flat = np.zeros(int(np.maximum(self.size - LENGTH + 1, 0).sum()), bool)
        base = np.cumsum(np.maximum(self.size - LENGTH + 1, 0)) - np.maximum(self.size - LENGTH + 1, 0)
        live = np.arange(self.n)
        row = np.arange(self.n)  # end marks come first, in the order of the texts
        run = np.searchsorted(self.run_start, row, "right") - 1
        for length in range(1, int(self.size.max(initial=0)) + 1):
            row = self.run_to[run] + row - self.run_start[run]
            run = np.searchsorted(self.run_start, row, "right") - 1
            if length >= LENGTH:
                window = self.size[live] - length
                flat[base[live] + window] = self.sample[run] < self.place[self.start[live] + window]
            more = self.size[live] > length
            live, row, run = live[more], row[more], run[more]
        for i, b in enumerate(base):
            out[i] = flat[b : b + len(out[i])]
        return out


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c and the windows found (two 64-bit maps) of snippets that come sorted by anchor, id, place and
    snippet. Rows that repeat an id may bring a snippet more than once; it counts once."""
    held: list[tuple[int, int, int, int, bytes]] = []
    held_bytes = 0

    def flush(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
        lo, hi, c = [], [], []
        _, owner = np.unique([r[1] for r in rows], return_inverse=True)
        index = RunLengthIndex([r[4] for r in rows], owner, np.array([r[2] >> 7 for r in rows]))
        for r, found in zip(rows, index.matches(), strict=True):
            bits = int.from_bytes(np.packbits(found, bitorder="little").tobytes(), "little")
            if bits:
                c.append(r[3])
                lo.append(bits & (1 << 63) - 1)
                hi.append(bits >> 63)
        return pa.record_batch([pa.array(c, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["c", "lo", "hi"])

    last: tuple = (None,)
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("f", "id", "at", "c", "bytes")), strict=True):
            if row[:4] == last[:4]:
                continue
            if held_bytes >= INDEX_BYTES and row[0] != last[0]:
                yield flush(held)
                held, held_bytes = [], 0
            held.append(row)
            held_bytes += len(row[4])
            last = row
    if held:
        yield flush(held)


# --- all steps -----------------------------------------------------------------------


def repeated_windows(docs: DataFrame) -> DataFrame:
    """id and marks: list of (at, c, lo, hi), windows of a document that have an earlier place."""
    scratch = Scratch(docs.sparkSession, "repeats")
    found = anchors(docs)
    often = found.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f")
    again = scratch.stage(found.join(often, "f"), "again")
    first = scratch.stage(again.groupBy("c").agg(F.min(F.struct("id", "at")).alias("first"), F.first("f").alias("f")), "first")

    # the bytes of first members
    wanted = first.select("c", "f", "first.id", "first.at").groupBy("id").agg(F.collect_list(F.struct("at", "c", "f")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, bytes]] = []
            for i, text, wanted in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                sums = prefix_hash(np.frombuffer(data, np.uint8))
                at = np.array([w["at"] for w in wanted])
                begin, end = at >> 7, np.minimum((at >> 7) + (at & 127) + LENGTH - 1, len(data))
                begin = np.minimum(begin, end)
                right = range_hash(sums, begin, end).view(np.int64) == np.array([w["c"] for w in wanted])  # rows may share an id
                out += [(w["f"], i, w["at"], w["c"], data[b:e]) for w, b, e, ok in zip(wanted, begin.tolist(), end.tolist(), right, strict=True) if ok]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["f", "id", "at", "c", "bytes"])

    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    texts = known.join(wanted, "id").mapInArrow(cut, "f bigint, id bigint, at bigint, c bigint, bytes binary")
    masks = texts.repartition("f").sortWithinPartitions("f", "id", "at", "c").mapInArrow(_masks, "c bigint, lo bigint, hi bigint")
    masks = scratch.stage(masks, "masks")
    judged = first.select("c", "first").join(masks, "c", "left")
    is_first = (F.col("id") == F.col("first.id")) & (F.col("at") == F.col("first.at"))
    every = F.lit((1 << 63) - 1)
    marks = (
        again.select("c", "id", "at").join(judged, "c")
        .select("id", "at", "c", *[F.when(is_first, F.coalesce(x, F.lit(0))).otherwise(every).alias(x) for x in ("lo", "hi")])
        .filter("lo <> 0 OR hi <> 0")
    )
    return scratch.stage(marks.groupBy("id").agg(F.collect_list(F.struct("at", "c", "lo", "hi")).alias("marks")), "marks")


def covered(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, marks: dict[str, np.ndarray]) -> np.ndarray:
    """Which bytes of texts laid end to end the marked windows cover; doc: the text of each mark.
    Marks of another text with the same id don't apply."""
    sums = prefix_hash(buf)
    count = marks["at"] & 127
    start = at[doc] + (marks["at"] >> 7)
    end = np.minimum(start + count + LENGTH - 1, at[doc + 1])
    start = np.minimum(start, end)
    right = range_hash(sums, start, end).view(np.int64) == marks["c"]
    start, count, lo, hi = start[right], count[right], marks["lo"][right], marks["hi"][right]
    ones = [(np.int64(1) << np.clip(n, 0, 62)) - 1 | np.where(n >= 63, np.int64(1) << 62, 0) for n in (count, count - 63)]
    full = ((lo & ones[0]) == ones[0]) & ((hi & ones[1]) == ones[1])
    change = np.zeros(len(buf) + 1, np.int64)
    np.add.at(change, start[full], 1)
    np.add.at(change, start[full] + count[full] - 1 + LENGTH, -1)
    for s, n, x, y in zip(*(v[~full].tolist() for v in (start, count, lo, hi)), strict=True):
        bits = (x | y << 63) & (1 << n) - 1
        for w in range(n):
            if bits >> w & 1:
                change[s + w] += 1
                change[s + w + LENGTH] -= 1
    return np.cumsum(change[:-1]) > 0


def judged(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For a batch with text and, as its last column, marks, in groups of rows: first and last row, bytes, offsets, bytes to remove."""
    buf, at = flat_text(batch.column("text"))
    lists = batch.column(batch.num_columns - 1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("at", "c", "lo", "hi")}
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for lo, hi, part, offsets in pieces(buf, at):
        own = slice(ends[lo], ends[hi])
        doc = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        yield lo, hi, part, offsets, covered(part, offsets, doc, {n: v[own] for n, v in values.items()})


def _joined(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns named, and behind them the marks of each row, in a column of an unused name."""
    rows = docs.select(*columns)
    id_, marks = unused(rows, "id", "marks")
    found = repeated_windows(docs).select(F.col("id").alias(id_), F.col("marks").alias(marks))
    return rows.join(found, F.col("doc_id") == F.col(id_), "left").select(*columns, marks)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, str]] = []
            for lo, hi, part, offsets, gone in judged(batch):
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                begins[inner] = gone[inner]  # a run ends with its text
                totals = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins)]
                for i in range(hi - lo):
                    a, b = offsets[i], offsets[i + 1]
                    removed = int(totals[0][i + 1] - totals[0][i])
                    kept = part[a:b][~gone[a:b]] if removed else part[a:b]
                    rows.append((int(b - a), removed, int(totals[1][i + 1] - totals[1][i]), hashlib.sha256(kept.tobytes()).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs with the bytes left as `text`; a character of which any byte goes, goes as
    a whole. A text that loses all goes with its row; null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = batch.column("text").to_pylist()
            for lo, hi, part, offsets, gone in judged(batch):
                if not gone.any():
                    continue
                char = np.cumsum((part & 0xC0) != 0x80) - 1
                bad = np.bincount(char, gone, int(char[-1]) + 1)[char] > 0
                for i in range(hi - lo):
                    a, b = offsets[i], offsets[i + 1]
                    if bad[a:b].any():
                        texts[lo + i] = part[a:b][~bad[a:b]].tobytes().decode()
            keep = pa.array([t != "" or not m.is_valid for t, m in zip(texts, batch.column(batch.num_columns - 1), strict=True)], pa.bool_())
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type)).filter(keep)
            yield out.select(names)

    names = docs.columns
    return _joined(docs, *names).mapInArrow(run, docs.schema)
