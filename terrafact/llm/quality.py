"""Operator 11: quality by a regularised quadratic discriminant.

A document is a point of 22 statistics of its text: log counts and lengths, and shares of kinds of characters and words
behind arcsin(sqrt(share)), which evens out their variance. Each class is a normal distribution. Its covariance
is shrunk twice: towards the pooled one, then towards a multiple of the identity. Both weights are chosen by likelihood
in five folds, each scored by what the other four give; all learn rows then give the means and covariances that are used.
A score is the difference of both log densities, from Mahalanobis distances by forward substitution with the
cached Cholesky factors, made a probability by a logistic curve fitted to the scores of the folds.

Nothing is sampled: tasks add up class counts, sums and products of all labelled rows, and Spark adds these up;
the driver sees a few matrices and histograms of fixed size. The text is read once; the statistics, 176 bytes a document, are staged.

Edge cases: null and empty texts, and texts without words, have statistics of zero like any others and get their
score. Documents without a label, or with a null one, are not learned from; with several labels the highest
counts; a document that repeats counts as often. If labels of one class are missing, every score is the share of ones among the
labels, one added to each class. Rows are scored each on their own, null ids included; an empty table gives no rows; other columns are not read.
Memory of a task: some sixty times the bytes of a piece of text, 2 MB; a longer document is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, distinct_per_text, flat_text, pieces, word_hashes, word_spans

#: Kinds of bytes: 0 others, then those named.
KINDS = np.zeros(256, np.uint8)
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, PAUSE = range(1, 8)
for _bytes, _kind in (
    (bytes(range(97, 123)) + bytes(range(128, 256)), LOWER),
    (bytes(range(65, 91)), UPPER),
    (b"0123456789", DIGIT),
    (b" \t\v\f\r", SPACE),
    (b"\n", LINE),
    (b".?", STOP),
    (b",;:'\"()-", PAUSE),
):
    KINDS[list(_bytes)] = _kind

#: Weights of shrinkage that are tried: towards the pooled covariance, and towards the identity.
TO_POOLED = (0.0, 0.1, 0.3, 0.6, 1.0)
TO_IDENTITY = (1e-4, 1e-3, 1e-2, 0.1)
FOLDS = 5
#: Weights where a class has all its labels in one fold, and the curve is left as it is.
FEW = (0.6, 0.1)
#: Bins of the histogram of score differences that the curve is fitted to.
BINS = 2048
N_STATS = 22


@dataclass
class QualityModel:
    """Two normal distributions by mean, Cholesky factor and log weight, and the curve; or one constant."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


# --- statistics of a text -----------------------------------------------------------------


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of N_STATS numbers for each text."""
    n = len(at) - 1
    out = np.zeros((n, N_STATS))
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    kinds = KINDS[buf]
    doc_of = np.repeat(np.arange(n), np.diff(at))
    by_kind = np.bincount(doc_of * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float) if len(buf) else np.zeros((n, 8))
    start, end = word_spans(buf, at)
    hashes, _, first = word_hashes(buf, at)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1).astype(float)
    length = (end - start).astype(float)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n) if len(doc) else np.zeros(n)

    def inside(kind: int) -> np.ndarray:
        """Bytes of a kind in each word."""
        before = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int32)])
        return before[end] - before[start]

    letters = (inside(LOWER), inside(UPPER))
    any_letter = letters[0] + letters[1] > 0
    shares = [
        by_kind[:, LOWER] / some, by_kind[:, UPPER] / some, by_kind[:, DIGIT] / some, by_kind[:, SPACE] / some,
        by_kind[:, LINE] / some, by_kind[:, STOP] / some, by_kind[:, PAUSE] / some, by_kind[:, 0] / some,
        per_text((length <= 3).astype(float)) / many, per_text((length >= 10).astype(float)) / many,
        per_text((~any_letter).astype(float)) / many, per_text(((letters[0] == 0) & (letters[1] > 0)).astype(float)) / many,
        per_text(((inside(0) > 0) & any_letter).astype(float)) / many,
        per_text((inside(STOP) > 0).astype(float)) / many,
        np.bincount(distinct_per_text(hashes, doc)[1], minlength=n) / many,
    ]
    same = np.zeros(len(doc))
    if len(doc) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shares.append(per_text(same) / many)
    mean = per_text(length) / many
    spread = np.sqrt(np.maximum(per_text(length**2) / many - mean**2, 0))
    counts = [size, words, mean, spread, words / (by_kind[:, STOP] + 1), size / (by_kind[:, LINE] + 1)]
    for k, share in enumerate(shares):
        out[:, k] = np.arcsin(np.sqrt(np.clip(share, 0, 1)))
    for k, count in enumerate(counts, len(shares)):
        out[:, k] = np.log1p(count)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text, `x`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            rows = [statistics(part, offsets) for _, _, part, offsets in pieces(buf, at)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * N_STATS), pa.array(flat))
            yield pa.record_batch([batch.column("doc_id"), x], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATS)


# --- learning -----------------------------------------------------------------------------


def moments(rows: DataFrame) -> np.ndarray:
    """For each fold and class: sums of products of (1, x), as one matrix."""
    size = N_STATS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * FOLDS, size, size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), _matrix(batch.column("x"))])
            group = batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy()
            for g in range(2 * FOLDS):
                part = x[group == g]
                total[g] += part.T @ part
        k = np.arange(total.size, dtype=np.int32)
        yield pa.record_batch([pa.array(k), pa.array(total.ravel())], ["k", "s"])

    parts = rows.select("x", "label", "fold").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s"))
    total = np.zeros(2 * FOLDS * size * size)
    for k, s in parts.collect():  # two matrices a fold
        total[k] = s
    return total.reshape(FOLDS, 2, size, size)


def _mean_cov(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def discriminant(zero: np.ndarray, one: np.ndarray, pooled: float, identity: float) -> QualityModel:
    """Both classes from their sums, shrunk by the given weights."""
    parts = [_mean_cov(zero), _mean_cov(one)]
    n = parts[0][0] + parts[1][0]
    common = sum(p[0] * p[2] for p in parts) / n
    # statistics differ in scale: the identity is that of their pooled variances
    scale = np.maximum(np.diag(common), 1e-6)
    factors, logs = [], []
    for count, _, cov in parts:
        c = (1 - pooled) * cov + pooled * common
        level = max(float(np.mean(np.diag(c) / scale)), 1e-3)
        c = (1 - identity) * c + identity * level * np.diag(scale)
        factors.append(np.linalg.cholesky(c + 1e-9 * np.diag(scale)))
        logs.append(np.log(count / n) - np.log(np.diag(factors[-1])).sum())
    return QualityModel(np.stack([p[1] for p in parts]), np.stack(factors), np.array(logs))


def difference(x: np.ndarray, model: QualityModel) -> np.ndarray:
    """Log density of class 1 less that of class 0, class weights included."""
    out = np.full(len(x), model.logs[1] - model.logs[0])
    for k, sign in ((1, -0.5), (0, 0.5)):
        left, factor = x - model.means[k], model.factors[k]
        z = np.zeros_like(left)
        for i in range(left.shape[1]):
            z[:, i] = (left[:, i] - z[:, :i] @ factor[i, :i]) / factor[i, i]
        out += sign * (z * z).sum(1)
    return out


def _bin(d: np.ndarray) -> np.ndarray:
    """Bins even in arcsinh of the difference, which spans many powers of ten."""
    return np.clip((np.arcsinh(d) / 40 + 0.5) * BINS, 0, BINS - 1).astype(np.int64)


_CENTRES = ((np.arange(BINS) + 0.5) / BINS - 0.5) * 40


def histograms(rows: DataFrame, models: list[list[QualityModel]]) -> np.ndarray:
    """Per pair of weights and class, how many rows fall into each bin, each row scored by its fold's models."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried = shared.value
        total = np.zeros((len(tried[0]), 2, BINS), np.int64)
        for batch in batches:
            x, label, fold = _matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                own = fold == f
                for k, model in enumerate(tried[f]) if own.any() else ():
                    at = label[own] * BINS + _bin(difference(x[own], model))
                    total[k] += np.bincount(at, minlength=2 * BINS).reshape(2, BINS)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total.ravel()[k])], ["k", "n"])

    parts = rows.select("x", "label", "fold").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n"))
    out = np.zeros(len(models[0]) * 2 * BINS)
    for k, n in parts.collect():  # at most pairs of weights x 2 x BINS
        out[k] = n
    return out.reshape(-1, 2, BINS)


def curve(counts: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Slope, offset and mean log-likelihood of the logistic curve through a histogram of both classes, by
    Newton's method; one pseudo-row of each class in the outermost bins keeps it finite."""
    n0, n1 = counts[0].copy(), counts[1].copy()
    n0[-1] += 1
    n1[0] += 1
    n, a, b = n0 + n1, 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * _CENTRES + b
        return float((n1 * np.logaddexp(0, -z) + n0 * np.logaddexp(0, z)).sum() / n.sum())

    best = loss(a, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * _CENTRES + b, -40, 40)))
        g, w = n * p - n1, n * p * (1 - p) + 1e-12
        h = np.array([[(w * _CENTRES**2).sum() + 1e-6, (w * _CENTRES).sum()], [(w * _CENTRES).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * _CENTRES).sum(), g.sum()])
        t = 1.0
        while loss(a - t * da, b - t * db) > best and t > 1e-6:
            t /= 2
        a, b = a - t * da, b - t * db
        now = loss(a, b)
        if best - now < 1e-12:
            break
        best = now
    return max(a, 1e-6), b, -best


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from the labelled documents among `stats` (doc_id, x)."""
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    fold: Column = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    sums = moments(stats.join(marks, "doc_id").withColumn("fold", fold))
    whole = sums.sum(0)
    n0, n1 = whole[:, 0, 0]
    if not n0 or not n1:
        none = np.zeros((2, N_STATS))
        return QualityModel(none, np.stack([np.eye(N_STATS)] * 2), np.zeros(2), constant=float((n1 + 1) / (n0 + n1 + 2)))
    weights = [(p, i) for p in TO_POOLED for i in TO_IDENTITY]
    others = whole - sums
    if others[:, :, 0, 0].min() < 1:
        return discriminant(whole[0], whole[1], *FEW)
    models = [[discriminant(o[0], o[1], p, i) for p, i in weights] for o in others]
    fitted = [curve(c) for c in histograms(stats.join(marks, "doc_id").withColumn("fold", fold), models)]
    k = max(range(len(fitted)), key=lambda k: fitted[k][2])
    model = discriminant(whole[0], whole[1], *weights[k])
    model.slope, model.offset = fitted[k][:2]
    return model


# --- scoring ------------------------------------------------------------------------------


def probability(x: np.ndarray, model: QualityModel) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    z = model.slope * np.arcsinh(difference(x, model)) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of each row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(_matrix(batch.column("x")), shared.value)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def staged_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of all documents, written once to the shared folder."""
    return Scratch(docs.sparkSession, "quality").stage(with_statistics(docs), "statistics")
