"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its hashed words and word beginnings; the
document's is their noisy-or, 1 - prod(1 - p). Only labels of documents are known: the gradient of
the documents' log-likelihood is passed through the noisy-or to the sentences, so that the model learns which
sentences make a document toxic. The same weights then locate them.

Edge cases: null and empty texts have no sentence and score 0; a document without a label, or with a
null one, is not learned from; with several labels the highest counts; without any label no word
has a weight and every score is below 1e-12. Rows are scored each on their own: null ids and repeated rows get
their results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_table, flat_text, mix, pieces, prefix_hash, range_hash, word_spans

BITS = 18
#: Bytes of a word's beginning that are a feature too.
STEM = 5
#: Labelled documents of each class in the sample: those with the smallest hashes.
SAMPLE = 2500

#: Words are runs of ASCII letters and digits and of bytes of other scripts.
_IN_WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bytes that end a sentence.
_ENDS = ~byte_table(b".!?\n")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sentence_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct feature of a sentence (two for a word: the whole word, and its first bytes,
    which words of one stem share) its bucket and sentence; of each sentence with words its text's index and the start of
    its first word."""
    start, end = word_spans(buf, at, _IN_WORDS)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = prefix_hash(LOWER[buf])
    hashes = np.stack([range_hash(sums, start, end), mix(range_hash(sums, start, np.minimum(end, start + STEM)))], 1).ravel()
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
    ends = np.searchsorted(np.flatnonzero(_ENDS[buf]), start)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ends[1:] != ends[:-1])
    sentence = np.repeat(np.cumsum(new) - 1, 2)
    both = np.sort(sentence << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    once = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=once[1:])
    both = both[once]
    return both & (1 << BITS) - 1, both >> BITS, doc[new], start[new]


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 300, rate: float = 0.08, decay: float = 3e-5) -> ToxicityModel:
    """Full-batch Adam on the documents' log-likelihood. A bag: buckets of words, and the index of
    the sentence that each word stands in."""
    model = ToxicityModel(np.zeros(1 << BITS, np.float32), -60.0)
    n = len(bags)
    if not n or not any(len(b) for b, _ in bags):
        return model
    word = np.concatenate([b for b, _ in bags])
    size = np.array([int(s[-1]) + 1 if len(s) else 0 for _, s in bags])
    base = np.concatenate([[0], np.cumsum(size)])
    sentence = np.concatenate([s + base[i] for i, (_, s) in enumerate(bags)])
    doc = np.repeat(np.arange(n), size)
    total = int(base[-1])
    used, word = np.unique(word, return_inverse=True)
    y = labels.astype(float)
    w, bias = np.zeros(len(used)), -np.log(max(total / n, 1.0)) - 1.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(sentence, w[word], total) + bias)
        whole = np.clip(noisy_or(p, doc, n), 1e-9, 1 - 1e-9)
        g = (np.where(y == 1, -(1 - whole) / whole, 1.0)[doc] * p) / n
        gw, gb = np.bincount(word, g[sentence], len(used)) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    model.weights[used], model.bias = w, float(bias)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from the labelled documents given: at most `sample` of each class, those whose id
    and text hash lowest. Only hashed words of the sample reach the driver."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    # the sample is drawn on ids; a limit behind an order keeps that many rows in each task
    for value in (0, 1):
        part = marks.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")  # at most two samples of ids

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            bags = []
            for lo, hi, part, offsets in pieces(buf, at):
                word, sentence, doc, _ = sentence_words(part, offsets)
                owner = doc[sentence] if len(doc) else sentence
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    s = sentence[cut[i] : cut[i + 1]]
                    bags.append((word[cut[i] : cut[i + 1]].astype(np.int32).tobytes(), (s - s[0] if len(s) else s).astype(np.int32).tobytes()))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([b for b, _ in bags], pa.binary()), pa.array([s for _, s in bags], pa.binary())],
                ["doc_id", "words", "sentences"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(words, f"doc_id {kind}, words binary, sentences binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
    bags = [(np.frombuffer(r["words"], np.int32).astype(np.int64), np.frombuffer(r["sentences"], np.int32).astype(np.int64)) for r in rows]
    return train(bags, np.array([ids[r["doc_id"]] for r in rows], int))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_sentences, n_toxic (sentences at 0.5 or more) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            n = len(batch)
            out, sentences, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, part, offsets in pieces(buf, at):
                word, sentence, doc, _ = sentence_words(part, offsets)
                p = sigmoid(np.bincount(sentence, m.weights[word], len(doc)) + m.bias)
                out[lo:hi] = noisy_or(p, doc, hi - lo)
                sentences[lo:hi] = np.bincount(doc, minlength=hi - lo)
                bad[lo:hi] = np.bincount(doc[p >= 0.5], minlength=hi - lo)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.clip(out, 0, 1)), pa.array(sentences), pa.array(bad)],
                ["doc_id", "score", "n_sentences", "n_toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_sentences bigint, n_toxic bigint")


def locate(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence, p: the sentences whose own probability reaches the threshold, from their
    first word to the byte that ends them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, at = flat_text(batch.column("text"))
            ids, texts, ps = [], [], []
            for lo, hi, part, offsets in pieces(buf, at):
                word, sentence, doc, start = sentence_words(part, offsets)
                p = sigmoid(np.bincount(sentence, m.weights[word], len(doc)) + m.bias)
                stops = np.flatnonzero(_ENDS[part])
                for i in np.flatnonzero(p >= threshold):
                    limit = int(offsets[doc[i] + 1])
                    k = np.searchsorted(stops, start[i])
                    end = min(limit, int(stops[k]) + 1) if k < len(stops) else limit
                    ids.append(lo + int(doc[i]))
                    texts.append(part[start[i] : end].tobytes().decode("utf-8", "replace"))
                    ps.append(float(p[i]))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(texts, pa.string()), pa.array(ps, pa.float64())],
                ["doc_id", "sentence", "p"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence string, p double")
