"""Helpers of the joins on token sets: rarity of hashed tokens, ordered sets, and exact overlap.

A token is known by 54 bits: its level of rarity (6 bits) and 48 bits of its hash, so that sorting
tokens as numbers puts rare ones first, in one order for the whole corpus. Levels come from counts
of hash buckets over all rows; a bucket's count is at least that of each of its tokens, and
whatever the levels are, the order is total, which is all that the filters need to be exact. Final
overlaps are counted with 64-bit hashes of the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, flat_text, mix, pieces

SKETCH_BITS = 18
HASH_BITS = 48
#: Texts whose tokens are sorted at once: as many as the bits left beside a token number.
OWNERS = 1 << 10
LEVELS = 64

Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def count_buckets(docs: DataFrame, tokens: Tokens, bits: int = SKETCH_BITS, piece: int = PIECE_BYTES) -> np.ndarray:
    """Counts of all tokens of the texts by bucket; 2**bits numbers, however large the corpus is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            buf, at = flat_text(batch.column(0))
            for _, _, part, offsets in pieces(buf, at, piece):
                h, _ = tokens(part, offsets)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        for lo in range(0, len(used), 1 << 16):
            some = used[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most 2**bits rows of two numbers
    out = np.zeros(1 << bits, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Two levels for each doubling of a bucket's count."""
    return np.minimum(2 * np.log2(counts + 1.0), LEVELS - 1).astype(np.uint8)


def ordered_sets(h: np.ndarray, first: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text as ascending numbers, rarest first, and how many each has."""
    shift = np.uint64(6 + HASH_BITS)
    bits = int(levels.size).bit_length() - 1
    level = levels[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    number = (level << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    out, sizes = [], np.zeros(len(first) - 1, np.int64)
    for lo in range(0, len(first) - 1, OWNERS):
        hi = min(lo + OWNERS, len(first) - 1)
        a, b = first[lo], first[hi]
        owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first[lo : hi + 1]))
        both = np.sort((owner << shift) | number[a:b])
        if len(both):
            new = np.ones(len(both), bool)
            np.not_equal(both[1:], both[:-1], out=new[1:])
            both = both[new]
        sizes[lo:hi] = np.bincount((both >> shift).astype(np.int64), minlength=hi - lo)
        out.append(both & np.uint64((1 << int(shift)) - 1))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def reduced(f: np.ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """f over each text's values; 0 where it has none."""
    out = np.zeros(len(sizes), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = f.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def fingerprints(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of whole sets."""
    return mix(reduced(np.add, mix(numbers + np.uint64(0x51ED270B)), sizes) + sizes.astype(np.uint64)).view(np.int64)


def min_hashes(numbers: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    return [reduced(np.minimum, mix(numbers ^ np.uint64(0x2545F4914F6CDD1D * (j + 1) % (1 << 64))), sizes).view(np.int64) for j in range(n)]


def parity_maps(numbers: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """For each set `words` 64-bit words: bit j tells whether an odd number of tokens fall on j. Maps
    of two sets differ in at most as many bits as the sets differ in tokens."""
    out = np.zeros((len(sizes), words), np.int64)
    bits = 64 * words
    place = (mix(numbers) % np.uint64(bits)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, len(sizes), OWNERS):
        hi = min(lo + OWNERS, len(sizes))
        owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        odd = np.bincount(owner * bits + place[ends[lo] : ends[hi]], minlength=(hi - lo) * bits) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(hi - lo, words)
    return out


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of a set of n with any partner at Jaccard num/den or more."""
    return -(-num * n // den)


def head(numbers: np.ndarray, sizes: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `want` tokens of each set."""
    want = np.minimum(want, sizes)
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return numbers[place < np.repeat(want, sizes)], want


def overlap(a: pa.Array, b: pa.Array, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of each row's two texts, and of their intersection."""
    n = len(a)
    na, nb, inter = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    (buf_a, at_a), (buf_b, at_b) = flat_text(a), flat_text(b)
    size = np.maximum(np.diff(at_a), np.diff(at_b))
    ends = np.cumsum(size)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 19), "right")))
        values, owners = [], []
        for buf, at, counts in ((buf_a, at_a, na), (buf_b, at_b, nb)):
            h, first = tokens(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            values.append(h[new])
            owners.append(owner[new])
            counts[lo:hi] = np.bincount(owner[new], minlength=hi - lo)
        h, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        twice = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        inter[lo:hi] = np.bincount(owner[1:][twice], minlength=hi - lo)
        lo = hi
    return na, nb, inter


def verified(pairs: DataFrame, texts: DataFrame, tokens: Tokens, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of class names whose texts (cls, text) reach Jaccard num/den. A text goes
    through two joins with its pairs; both split hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, inter = overlap(batch.column("text_a"), batch.column("text_b"), tokens)
            ok = pa.array((inter > 0) & (den * inter >= num * (na + nb - inter)))
            yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")
