"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, pairs
of adjacent words, and character n-grams (runs of 3 and 5 bytes, across words).
In a pair, a word equal to the one before it is written as a ditto, so that
repetition is one feature whatever the word. A softmax over the mean gives the
probability of label 1. Vectors and softmax are trained together by stochastic
gradient descent on a bounded sample of labelled rows (``per_class`` of each
label), weighted back to the labels' shares.

The output is linear in the mean vector, so scoring folds every vector into one
number per bucket; a task scans bytes, looks buckets up and averages.

Empty, blank-only and null texts: a text without any feature gets the share of
label 1, the prior. Repeated rows get equal scores. No usable labels of both
kinds: every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.sample import in_fold, labelled_sample
from threadloom.llm.spans import Chunk, chunks, mix, span_hash, text_bytes

BUCKET_BITS = 16
DIMENSIONS = 8
PER_CLASS = 1_000
EPOCHS = 5
RATE = 0.4
THRESHOLD = 0.7
NGRAMS = (3, 5)
_DITTO = np.uint64(0x5851F42D4C957F2D)


def _ngram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each position; the last n - 1 positions have none."""
    size = max(0, len(data) - n + 1)
    code = np.zeros(size, np.uint32)
    for i in range(n):
        code *= np.uint32(0x01000193)
        code ^= data[i : i + size]
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77 + 2 * n)
    return code >> np.uint32(32 - BUCKET_BITS)


def _features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets in text order, with the run of them that each document owns."""
    shift = np.uint64(64 - BUCKET_BITS)
    starts, ends, _ = chunk.words()
    word = span_hash(chunk.prefix(), starts, ends)
    first = np.searchsorted(starts, chunk.offsets)
    yield (word >> shift).astype(np.int64), first[:-1], first[1:]
    if len(word) > 1:
        second = np.where(word[1:] == word[:-1], _DITTO, word[1:])
        left = np.where(word[1:] == word[:-1], _DITTO, word[:-1])
        pair = mix(left * np.uint64(0x9E3779B97F4A7C15) + second)
        begin = np.minimum(first[:-1], len(pair))
        yield (pair >> shift).astype(np.int64), begin, np.maximum(begin, first[1:] - 1)
    for n in NGRAMS:
        begin = np.minimum(chunk.offsets[:-1], max(0, len(chunk.data) - n + 1))
        stop = np.maximum(begin, chunk.offsets[1:] - n + 1)
        yield _ngram_buckets(chunk.data, n), begin, stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each sampled document and how often each occurs."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        buckets, counts = [], []
        for row in range(len(offsets) - 1):
            one = Chunk(row, data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))
            seen = np.bincount(
                np.concatenate([f[a[0] : b[0]].astype(np.int64) for f, a, b in _features(one)]),
                minlength=1 << BUCKET_BITS,
            )
            own = np.flatnonzero(seen)
            buckets.append(own.astype(np.uint16).tobytes())
            counts.append(seen[own].astype(np.uint32).tobytes())
        yield pa.record_batch(
            [pa.array(buckets, pa.binary()), pa.array(counts, pa.binary()), batch.column(1), batch.column(2)],
            ["buckets", "counts", "label", "doc_id"],
        )


@dataclass
class Model:
    """``weight`` of each bucket and ``bias`` of the log-odds of label 1."""

    weight: np.ndarray
    bias: float
    prior: float


def train(rows: list, counts: dict[int, int], seed: int = 11) -> Model:
    """Fit on (buckets, counts, label, doc_id, copies) rows, in the order of their ids."""
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    size = 1 << BUCKET_BITS
    docs = []
    for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["buckets"]), bytes(r["counts"]))):
        own, often = np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32)
        if len(own):
            docs += [(own, (often / often.sum()).astype(np.float32)[:, None], r["label"])] * r["copies"]
    have = [sum(d[2] == v for d in docs) for v in (0, 1)]
    if min(have) == 0:
        return Model(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5, 0.5, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            own, share, label = docs[i]
            rate = RATE * (1 - done / steps)
            vectors = table[own]
            hidden = (vectors * share).sum(0)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            # balanced in the sample: each class counts alike, the shares come back in the bias
            gap = -p
            gap[label] += 1
            gap *= 0.5 * len(docs) / have[label]
            back = out @ gap
            out += rate * np.outer(hidden, gap)
            bias += rate * gap
            table[own] = vectors + rate * back
            done += 1
    odds = np.log(prior / (1 - prior))
    fold = table @ (out[:, 1] - out[:, 0])
    return Model(fold.astype(np.float32), float(bias[1] - bias[0] + odds), prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labels whose crc32(doc_id) modulo 4 is not 2; the driver sees only bucket counts."""
    rows, counts = labelled_sample(docs, labels, "quality", 4, 2, per_class)
    made = rows.select("text", "label", "doc_id").mapInArrow(
        _counted, "buckets binary, counts binary, label int, doc_id long"
    )
    # rows of one id with the same text come as one, with their number
    folded = made.groupBy("buckets", "counts", "label", "doc_id").agg(F.count("*").alias("copies"))
    return train(folded.collect(), counts)


def _scores(weight: np.ndarray, bias: float, prior: float, texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for chunk in chunks(data, offsets):
        here = slice(chunk.first, chunk.first + chunk.n)
        for buckets, begin, stop in _features(chunk):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(weight[buckets], out=sums[1:])
            total[here] += sums[stop] - sums[begin]
            n[here] += stop - begin
    score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -60, 60)))
    return pa.array(np.where(n > 0, score, prior))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text; narrow, and only texts go to Python."""
    shared = SparkSession.active().sparkContext.broadcast(model.weight)
    bias, prior = model.bias, model.prior

    def scored(texts: pa.Array) -> pa.Array:
        return _scores(shared.value, bias, prior, texts)

    return F.arrow_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs.select("doc_id", "text"), labels)
    made = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return made.select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted as good, with their own columns only."""
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.where(score(docs["text"], model) >= threshold)
