"""Operator 3: language identification.

A text is the average of the embeddings of its hashed subwords (runs of 3 and 4 bytes of the text in
lower case, with everything but letters as blanks); a linear softmax on the average names the
language. Embeddings and weights are trained by stochastic gradient descent in numpy, on a bounded sample.
As the model is linear behind the average, embeddings and weights are multiplied once after
training, and scoring adds one row per subword.

Calibration: a part of the sample is kept out of training; one temperature is fitted on it, and
`accepted` says that the calibrated probability of the named language is at least `accept`.

Edge cases: null, empty and letterless texts are `und` with score 0, not accepted; ties go to the
language that is first by name; languages are learned from rows with a language that isn't null;
with no such row every text is `und`. Rows are independent of each other; repeated rows and null ids
get a result each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_text, importable, pieces

UNKNOWN = "und"
BITS = 16
SIZES = (3, 4)
#: Documents of each language in the sample: those with the smallest hashes of their ids.
SAMPLE = 500
#: Bytes of one sampled document that a training step looks at: a random window, as large as this.
WINDOW = 6000

#: Bytes of text worked on at once; arrays of subwords take some thirty times as much.
PIECE = 1 << 19

#: Bytes as subwords see them: small letters, bytes of other letters, and blanks.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    languages: list[str]
    rows: np.ndarray  # subwords x languages
    bias: np.ndarray
    temperature: float


def subwords(buf: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the subwords that start at each byte, as far as they are whole."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for j in range(size):
        h |= buf[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64) + (size - SIZES[0] << BITS)


def features(text: bytes) -> np.ndarray:
    buf = _LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)]
    return np.concatenate([subwords(buf, s) for s in SIZES])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    texts: list[bytes], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 4.0, seed: int = 7
) -> LanguageModel | None:
    """Fits embeddings, weights and temperature; None without labelled texts."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.uniform(-1 / dim, 1 / dim, (len(SIZES) << BITS, dim)).astype(np.float32)
    weight = np.zeros((dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)

    def window(i: int, size: int) -> bytes:
        text = texts[i]
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        return text[at : at + size]

    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            lr = rate * (1 - done / steps)
            done += 1
            # every other step sees a piece as short as a sentence
            f, n = np.unique(features(window(i, WINDOW if done % 2 else 80)), return_counts=True)
            if not len(f):
                continue
            share = (n / n.sum()).astype(np.float32)
            rows = table[f]
            mean = share @ rows
            g = softmax(mean @ weight + bias)
            g[label[i]] -= 1
            back = weight @ g
            weight -= lr * np.outer(mean, g)
            bias -= 0.01 * lr * g
            table[f] = rows - lr * share[:, None] * back
    model = LanguageModel(names, (table @ weight).astype(np.float32), bias, 1.0)
    if len(held):
        z = np.array([model.rows[f].mean(0) + bias if len(f := features(texts[i])) else bias for i in held])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), label[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learns from text and lang of `docs` alone: `sample` rows of each language, those whose ids
    hash lowest. The bound is on rows, for each language, whatever the corpus holds."""
    importable(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # tasks keep `sample` rows a language
    ids = [r[0] for r in known.select("lang", "h", rank.alias("r")).filter(F.col("r") <= sample).select("h").distinct().collect()]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "h bigint")
    rows = (
        known.select("lang", "text", "h").join(F.broadcast(wanted), "h", "left_semi")  # `sample` ids a language
        .filter("text RLIKE '\\\\p{L}'").select("lang", "text").collect()
    )
    texts, labels = [], []
    for lang, text in sorted(rows):
        texts.append(text.encode())
        labels.append(lang)
    return train(texts, labels)


def _scores(model: LanguageModel, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits of each text: the mean row of its subwords. Texts are laid out with a blank on both
    sides, so that no subword of two texts mixes into either."""
    n = len(at) - 1
    size = np.diff(at)
    start = at[:-1] + np.arange(n) * 2
    padded = np.full(int(at[-1]) + 2 * n, 32, np.uint8)
    if at[-1]:
        padded[np.arange(int(at[-1])) + np.repeat(np.arange(n) * 2 + 1, size)] = _LETTERS[buf]
    total = np.zeros((n, len(model.languages)), np.float64)
    count = np.zeros(n)
    for s in SIZES:
        here = np.maximum(size + 2 - s + 1, 0)
        some = np.flatnonzero(here)
        if not len(some):
            continue
        ids = subwords(padded, s)
        edges = np.stack([start[some], start[some] + here[some]], 1).ravel()
        over = edges >= len(ids)
        for k in range(total.shape[1]):
            values = np.append(model.rows[:, k][ids], np.float32(0))
            total[some, k] += np.add.reduceat(values, np.where(over, len(ids), edges), dtype=np.float64)[::2]
        count[some] += here[some]
    return total / np.maximum(count, 1)[:, None] + model.bias


def predict(docs: DataFrame, model: LanguageModel | None, accept: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score, accepted of each row, from its text alone."""
    lettered = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return lettered.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")
        )
    judge = _judge(docs, model, accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, accepted = judge(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return lettered.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def accepted_rows(docs: DataFrame, model: LanguageModel | None, accept: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is accepted; none without a model."""
    if model is None:
        return docs.filter("1 = 0")
    judge = _judge(docs, model, accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch)[2])).select(names)

    names = docs.columns
    has = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__has")
    return docs.select(*names, has).mapInArrow(run, docs.schema)


def _judge(docs: DataFrame, model: LanguageModel, accept: float) -> Callable:
    """From a batch with text and, as its last column, whether the text has a letter: names, scores,
    whether accepted."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the languages

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        buf, at = flat_text(batch.column("text"))
        has = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        best, score = np.zeros(len(has), np.int64), np.zeros(len(has))
        for lo, hi, part, offsets in pieces(buf, at, PIECE):
            p = softmax(_scores(m, part, offsets) / m.temperature)
            best[lo:hi] = p.argmax(1)
            score[lo:hi] = p.max(1)
        best[~has] = len(m.languages)
        score[~has] = 0.0
        return names[best], np.clip(score, 0, 1), has & (score >= accept)

    return run
