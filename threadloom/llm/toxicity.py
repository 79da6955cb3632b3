"""Toxicity: weak supervision of lexicon and pattern voters, and a linear classifier.

Voters. A given list of insults, and word beginnings found in the sample that
occur in toxic texts and hardly elsewhere, each vote "toxic" where they occur;
patterns vote on several different hits, on their density, and, the other way
round, on there being none. The labels of the sample are one voter more.

Label model. A generative model with a hidden label estimates by expectation
maximisation how often each voter speaks under either label. Correlations are
what voters still share once the label is known; a voter's evidence is divided
by one plus the squares of its correlations, so that many beginnings of the
same words do not count many times. Its posterior labels train a logistic
regression on the voters' outputs, with classes weighted back to their shares.

The sample is bounded (``PER_CLASS`` whole texts of each label); the score of a
document is one narrow pass: words are hashed, looked up, and summed.

Null, empty and blank texts have no hits and get the score of such texts. Repeated
rows get equal scores. Without labels only the given list votes, by ``DEFAULT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.sample import in_fold, labelled_sample
from threadloom.llm.spans import Chunk, chunks, lower_latin, per_document, span_hash, text_bytes

INSULTS = (
    "bastard", "clown", "coward", "creep", "cretin", "degenerate", "dickhead", "disgusting", "dumb", "dumbass", "filth",
    "fool", "freak", "garbage", "idiot", "idiotic", "imbecile", "jerk", "liar", "loser", "lunatic", "maggot", "moron",
    "moronic", "parasite", "pathetic", "pig", "rat", "scum", "scumbag", "stupid", "subhuman", "trash", "ugly", "useless",
    "vermin", "worthless", "wretch",
)
PER_CLASS = 1_500
PREFIXES = (4, 5, 6, 7)
MOST_MINED = 200
CHANCE = 0.05
DENSITY = 0.003
DEFAULT = 0.9
THRESHOLD = 0.5
_BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _word_keys(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word and of its beginnings (0 where the word is shorter), and the words' documents."""
    low = Chunk(chunk.first, lower_latin(chunk.data), chunk.offsets)
    starts, ends, owner = low.words(_LETTER[low.data])
    prefix = low.prefix()
    keys = [span_hash(prefix, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        key = np.zeros(len(starts), np.uint64)
        key[long] = span_hash(prefix, starts[long], starts[long] + n)
        keys.append(key)
    return keys, owner


def word_key(word: str) -> int:
    """The hash under which a word or a beginning is looked up."""
    data = lower_latin(np.frombuffer(word.encode(), np.uint8))
    one = Chunk(0, data, np.array([0, len(data)]))
    return int(span_hash(one.prefix(), np.array([0]), np.array([len(data)]))[0])


@dataclass
class Voters:
    """Sorted keys of the lexicon voters and a first filter on hash bits."""

    keys: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, keys: list[int]) -> Voters:
        ordered = np.unique(np.array(keys, np.uint64))
        known = np.zeros(1 << _BITS, bool)
        known[(ordered >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls(ordered, known)

    def counts(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, voters) hits, and per document the words hit and all words."""
        keys, owner = _word_keys(chunk)
        out = np.zeros((chunk.n, len(self.keys)), np.float64)
        hit = np.zeros(len(owner), bool)
        for key in keys:
            at = np.flatnonzero(self.known[(key >> np.uint64(64 - _BITS)).astype(np.int64)] & (key != 0))
            if len(at) and len(self.keys):
                which = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
                good = self.keys[which] == key[at]
                at, which = at[good], which[good]
                np.add.at(out, (owner[at], which), 1)
                hit[at] = True
        first = np.searchsorted(owner, np.arange(chunk.n + 1))
        return out, per_document(hit, first), np.diff(first)


def _outputs(counts: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0/1 outputs: each lexicon voter, then several hits, density, many hits, no hit."""
    share = hits / np.maximum(words, 1)
    more = np.stack([hits >= 2, share >= DENSITY, hits >= 5, hits == 0], axis=1)
    return np.concatenate([counts > 0, more], axis=1).astype(np.float64)


@dataclass
class LabelModel:
    """P(a voter speaks | label) for labels 0 and 1, and each voter's independent share of evidence."""

    speaks: np.ndarray
    share: np.ndarray
    prior: float

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
        model = cls(np.zeros((2, votes.shape[1])), np.ones(votes.shape[1]), prior)
        q = start
        for step in range(rounds):
            for y, weight in enumerate((1 - q, q)):
                model.speaks[y] = (weight @ votes + 0.5) / (weight.sum() + 1)
            if step in (5, 15):
                model.share = 1 / (1 + (model.correlations(votes, q) ** 2).sum(1))
            q = model.posterior(votes)
        return model

    def correlations(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What pairs of voters share beyond the label; 0 on the diagonal."""
        left = votes - (np.outer(1 - q, self.speaks[0]) + np.outer(q, self.speaks[1]))
        scale = np.sqrt((left**2).mean(0)) + 1e-6
        made = (left.T @ left) / len(votes) / np.outer(scale, scale)
        np.fill_diagonal(made, 0)
        return np.where(np.abs(made) > 0.1, made, 0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        p = np.clip(self.speaks, 1e-4, 1 - 1e-4)
        yes = np.log(p[1] / p[0]) * self.share
        no = np.log((1 - p[1]) / (1 - p[0])) * self.share
        odds = votes @ yes + (1 - votes) @ no + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps; soft targets."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - keep * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    voters: Voters
    weight: np.ndarray
    bias: float

    def score(self, chunk: Chunk) -> np.ndarray:
        logit = _outputs(*self.voters.counts(chunk)) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _one(data: np.ndarray, offsets: np.ndarray, row: int) -> Chunk:
    return Chunk(row, data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each sampled text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        keys = [np.unique(np.concatenate(_word_keys(_one(data, offsets, r))[0])).tobytes() for r in range(len(offsets) - 1)]
        yield pa.record_batch([pa.array(keys, pa.binary()), batch.column(1)], ["keys", "label"])


def _mine(rows: list) -> list[int]:
    """Keys that occur 20 times more often in toxic texts than elsewhere, beyond what chance gives among so many keys."""
    parts = {y: [np.frombuffer(r["keys"], np.uint64) for r in rows if r["label"] == y] for y in (0, 1)}
    if not parts[0] or not parts[1]:
        return []
    key, n1 = np.unique(np.concatenate(parts[1]), return_counts=True)
    other = np.concatenate(parts[0])
    at = np.minimum(np.searchsorted(key, other), max(0, len(key) - 1))
    n0 = np.bincount(at[key[at] == other], minlength=len(key))
    share = len(parts[1]) / len(rows)
    lift = (n1 / len(parts[1])) / ((n0 + 0.5) / len(parts[0]))
    n = n0 + n1
    gain = n1 * np.log(n1 / n / share) + n0 * np.log(np.maximum(n0, 1) / n / (1 - share))
    good = np.flatnonzero((lift >= 20) & (key != 0) & (gain >= np.log(len(key) / CHANCE)))
    return [int(k) for k in key[good[np.lexsort((key[good], -gain[good]))]][:MOST_MINED]]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labels whose crc32(doc_id) modulo 5 is not 0; the driver sees hashes and hits of the sample."""
    rows, counts = labelled_sample(docs, labels, "toxic", 5, 0, per_class)
    rows = rows.select("text", "label", "doc_id").persist()
    mined = _mine(rows.mapInArrow(_distinct, "keys binary, label int").collect())
    voters = Voters.of([word_key(w) for w in INSULTS] + mined)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            made = [
                _outputs(*shared.value.counts(_one(data, offsets, r)))[0].astype(np.uint8).tobytes() for r in range(len(offsets) - 1)
            ]
            yield pa.record_batch([pa.array(made, pa.binary()), batch.column(1), batch.column(2)], ["votes", "label", "doc_id"])

    got = rows.mapInArrow(hits, "votes binary, label int, doc_id long").collect()
    rows.unpersist()
    got.sort(key=lambda r: (r["doc_id"], r["votes"]))
    n = len(voters.keys) + 4
    label = np.array([r["label"] for r in got], float)
    if not len(got) or label.min() == label.max():
        weight = np.zeros(n)
        weight[-1] = -2 * np.log(DEFAULT / (1 - DEFAULT))
        return Model(voters, weight, float(np.log(DEFAULT / (1 - DEFAULT))))
    votes = np.array([np.frombuffer(r["votes"], np.uint8) for r in got], float)
    seen = np.hstack([votes, label[:, None]])
    start = np.clip(0.1 + 0.8 * (votes[:, -1] == 0), 0, 1)
    q = LabelModel.fit(seen, start, 0.5).posterior(seen)
    total = counts.get(0, 0) + counts.get(1, 0)
    share = np.where(label == 1, counts.get(1, 0) / total / label.mean(), counts.get(0, 0) / total / (1 - label.mean()))
    weight, bias = _logistic(votes, q, share)
    return Model(voters, weight, bias)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text; narrow, and only texts go to Python."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        parts = [shared.value.score(chunk) for chunk in chunks(data, offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(scored, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs.select("doc_id", "text"), labels)
    made = docs.select("doc_id", score(docs["text"], model).alias("score"))
    return made.select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
