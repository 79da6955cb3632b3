"""Language-model scoring: marginal likelihood over subword lattices, beside a word model.

Both models learn from documents whose crc32(doc_id) modulo 10 is not 0, all of
them. Tokens are words, ASCII lower case, and one end per document.

Word model (``base_score``): counts of all training tokens, smoothed by 0.1.

Subword model (``score``): the pieces of an existing vocabulary (a parameter,
never trained) with its scores as prior. One expectation step over the lattices
of all training words gives each piece its expected count, ``PRIOR`` tokens of
the vocabulary's own scores are added, and the end of a text is a symbol beside
the pieces. The score of a text is the log10 probability of its words, each summed
over all its segmentations, and of its end.

Word counts are exchanged between shelves of documents (see ``shelves``): a word
costs one entry per shelf, however frequent, and the word table is never in one
place. Words are told apart by 64-bit hashes.

Null and empty texts are an end only. A null id is not held out. Repeated rows
are scored alike and counted as often as they occur. Without training documents
counts are 0 and the vocabulary's scores alone make the subword model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import lattice, shelves
from threadloom.llm.spans import Chunk, arrow_rows, lower_ascii, per_document, span_hash
from threadloom.session import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PRIOR = 1_000.0
SMOOTH = 0.1
FOLD = 10


def _held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.array([bool(k) and zlib.crc32(str(i).encode()) % FOLD == 0 for i, k in zip(ids.tolist(), known, strict=True)], bool)


class _Words:
    """Distinct words of a shelf: hash, place of one occurrence, and the words of each document."""

    def __init__(self, chunk: Chunk) -> None:
        self.data = lower_ascii(chunk.data)
        low = Chunk(0, self.data, chunk.offsets)
        starts, ends, self.owner = low.words()
        hashes = np.empty(len(starts), np.uint64)
        # hash sums are taken piecewise, so that they stay small beside the text
        for begin in range(0, chunk.n, 512):
            stop = min(chunk.n, begin + 512)
            a, b = np.searchsorted(self.owner, [begin, stop])
            base = chunk.offsets[begin]
            part = Chunk(0, self.data[base : chunk.offsets[stop]], np.array([0]))
            hashes[a:b] = span_hash(part.prefix(), starts[a:b] - base, ends[a:b] - base)
        order = np.argsort(hashes)
        new = np.append(True, hashes[order][1:] != hashes[order][:-1]) if len(order) else np.zeros(0, bool)
        self.hash = hashes[order][new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.starts, self.ends = starts[order][new], ends[order][new]
        self.first = np.searchsorted(self.owner, np.arange(chunk.n + 1))


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    tables = Scratch(spark, "language-model")
    strings, prior = lattice.vocabulary(vocabulary)
    pieces = spark.sparkContext.broadcast((lattice.Pieces.of(strings), prior))
    made = shelves.shelve(docs, tables)
    buckets = shelves.buckets_for(made.agg(F.sum("n_bytes")).first()[0] or 0)

    def letters(ids: np.ndarray, known: np.ndarray, chunk: Chunk) -> list[tuple[int, bytes]]:
        words, train = _Words(chunk), ~_held_out(ids, known)
        count = np.bincount(words.of, train[words.owner].astype(float), minlength=len(words.hash)).astype(np.int64)
        lattices, logs = pieces.value
        own = np.flatnonzero(count)
        _, expected = lattice.word_logs(words.data, words.starts[own], words.ends[own], lattices, logs, count[own].astype(float))
        out = [(-1, expected.tobytes()), (-2, np.array([count.sum(), train.sum()], np.int64).tobytes())]
        for bucket, at in enumerate(shelves.by_bucket(words.hash, buckets)):
            if len(at):
                out.append((bucket, words.hash[at].tobytes() + count[at].astype(np.int32).tobytes()))
        return out

    with arrow_rows(spark, 1):
        sent = tables.table(shelves.send(made, letters), "letters")

    def summed(kind: str) -> dict[int, float]:
        """Column sums of the vectors that shelves sent under a bucket below 0."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for batch in batches:
                for body in batch.column(0):
                    one = np.frombuffer(body.as_py(), kind).astype(float)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "value"])

        which = sent.where(F.col("bucket") == (-1 if kind == "f8" else -2)).select("body")
        # one row per piece of the vocabulary
        rows = which.mapInArrow(spread, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
        return {r["i"]: r["value"] for r in rows}

    totals = summed("i8")
    train_words, train_docs = int(totals.get(0, 0)), int(totals.get(1, 0))
    expected = summed("f8")
    count = np.array([expected.get(i, 0.0) for i in range(len(strings))]) + PRIOR * np.exp(prior)
    ends = train_docs + PRIOR / 100
    logs = np.log(count / (count.sum() + ends))
    end_log10 = float(np.log10(ends / (count.sum() + ends)))

    def merge(bodies: list[bytes]) -> list[bytes]:
        sizes = [len(b) // 12 for b in bodies]
        keys = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(b, np.int32, n, 8 * n) for b, n in zip(bodies, sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, counts.astype(float)).astype(np.int64)
        distinct = int((total > 0).sum())
        cuts = np.cumsum([0, *sizes])
        # the bucket's number of distinct training words goes with its first answer
        return [
            np.array([distinct if i == 0 else 0], np.int64).tobytes() + total[group[cuts[i] : cuts[i + 1]]].tobytes()
            for i in range(len(bodies))
        ]

    answers = tables.table(shelves.answer(sent.where("bucket >= 0"), merge), "answers")
    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([int.from_bytes(b.as_py(), "little") for b in batch.column(0)], pa.int64())], ["n"])

    heads = answers.select(F.substring("body", 1, 8).alias("head")).mapInArrow(fronts, "n long")
    distinct = heads.agg(F.sum("n")).first()[0] or 0
    n_tokens, distinct = train_words + train_docs, distinct + (train_docs > 0)
    below = n_tokens + SMOOTH * (distinct + 1)
    model = spark.sparkContext.broadcast(logs)

    def result(ids: np.ndarray, known: np.ndarray, chunk: Chunk, found: dict[int, bytes]) -> pa.Table:
        words = _Words(chunk)
        count = np.zeros(len(words.hash), np.int64)
        for bucket, at in enumerate(shelves.by_bucket(words.hash, buckets)):
            if len(at):
                count[at] = np.frombuffer(found[bucket], np.int64, len(at), 8)
        own, _ = lattice.word_logs(words.data, words.starts, words.ends, pieces.value[0], model.value)
        size = np.diff(words.first)
        base = per_document(np.log10((count + SMOOTH) / below)[words.of], words.first) + np.log10((train_docs + SMOOTH) / below)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=~known),
                "held_out": _held_out(ids, known),
                "n_tokens": size + 1,
                "n_known": per_document((count > 0)[words.of], words.first) + (train_docs > 0),
                "train_tokens": np.full(chunk.n, n_tokens),
                "base_score": base,
                "score": per_document((own / np.log(10))[words.of], words.first) + end_log10,
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return shelves.open_answers(made, answers, result, schema)
