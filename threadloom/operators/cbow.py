"""Word vectors by continuous bag of words with negative sampling.

Sentences are dealt to a fixed number of shards by their digest. In an epoch every
shard starts from the same parameters, streams its sentences through a numpy
descent, and sends the rows it touched; rows are averaged over shards, weighted by
how often each touched them, in a tree of partial sums. Parameters are two vectors
per vocabulary entry, so what tasks and driver hold is bounded by the vocabulary,
and what is sent by shards times that, whatever the corpus.

Draws depend on seed, epoch and shard only, and sentences of a shard are sorted,
so reruns give the same vectors. Equal sentences are trained as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.session import at_most, scratch

MOST_VALUES = 512_000_000
NOISE_POWER = 0.75
BRANCH = 16
SENTENCES = 2_000
_BODY_VALUES = 1 << 14
_BODY = "matrix int, part int, shard int, weight binary, total binary"


@dataclass(frozen=True)
class Settings:
    """Defaults of the usual trainer: window 5, 5 negatives, 5 epochs, rate 0.025 down to 0.0001."""

    dim: int = V.WORD_VECTOR_DIM
    window: int = 5
    negative: int = 5
    rate: float = 0.025
    least_rate: float = 0.0001
    epochs: int = 5
    min_count: int = 1
    sample: float = 1e-3
    seed: int = V.SPLIT_SEED
    shards: int = 8
    batch: int = 256


# --- one batch -------------------------------------------------------------------


def _add_rows(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``matrix[rows] += values`` with repeated rows added up first."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    matrix[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


def descend(
    inner: np.ndarray, outer: np.ndarray, context: np.ndarray, used: np.ndarray,
    target: np.ndarray, noise: np.ndarray, rate: float,
) -> None:
    """One step for a batch of positions, in place.

    ``context`` has the ids around each position and ``used`` which of them count;
    their mean predicts ``target`` against ``noise``. Draws that hit the target are
    left out. Each context vector takes the whole error, as word2vec does.
    """
    count = used.sum(axis=1)
    mean = (inner[context] * used[:, :, None]).sum(axis=1) / count[:, None]
    ids = np.concatenate([target[:, None], noise], axis=1)
    label = np.zeros(ids.shape, np.float32)
    label[:, 0] = 1
    against = outer[ids]
    score = np.einsum("bd,bkd->bk", mean, against)
    step = (label - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) * np.float32(rate)
    step[:, 1:] *= noise != target[:, None]
    step = step.astype(np.float32)
    error = np.einsum("bk,bkd->bd", step, against)
    _add_rows(outer, ids.ravel(), (step[:, :, None] * mean[:, None, :]).reshape(-1, mean.shape[1]))
    row, column = np.nonzero(used)
    _add_rows(inner, context[row, column], error[row])


def positions(
    tokens: np.ndarray, sentence: np.ndarray, window: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Places around each token within a drawn window, and which of them are of its sentence."""
    reach = rng.integers(1, window + 1, len(tokens))
    offsets = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    place = np.arange(len(tokens))[:, None] + offsets
    inside = (place >= 0) & (place < len(tokens)) & (np.abs(offsets) <= reach[:, None])
    place = np.clip(place, 0, max(0, len(tokens) - 1))
    return place, inside & (sentence[place] == sentence[:, None])


# --- shards --------------------------------------------------------------------------


def _start(n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([s.seed, n, s.dim])
    inner = ((rng.random((n, s.dim), np.float32) - 0.5) / s.dim).astype(np.float32)
    return inner, np.zeros((n, s.dim), np.float32)


def _rows_per_body(dim: int) -> int:
    return max(1, _BODY_VALUES // dim)


class _Shard:
    """One shard's own copy of the parameters, on its way through its sentences."""

    def __init__(self, number: int, shared: tuple, epoch: int, s: Settings) -> None:
        inner, outer, self.keep, self.noise = shared
        self.inner, self.outer = inner.copy(), outer.copy()
        self.number, self.epoch, self.s = number, epoch, s
        self.touched = np.zeros((2, len(inner)), np.float64)
        self.rng = np.random.default_rng([s.seed, epoch, number])

    def train(self, rows: pa.RecordBatch) -> None:
        """Sentences (ids, share), in order; ``share`` is how far the shard has come."""
        s, rng = self.s, self.rng
        lists, share = rows.column(0), np.asarray(rows.column(1))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        tokens = np.asarray(lists.flatten()).astype(np.int64)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        stays = rng.random(len(tokens)) < self.keep[tokens]
        tokens, sentence = tokens[stays], sentence[stays]
        place, used = positions(tokens, sentence, s.window, rng)
        trained = np.flatnonzero(used.any(axis=1))
        for begin in range(0, len(trained), s.batch):
            at = trained[begin : begin + s.batch]
            done = (self.epoch + share[sentence[at[0]]]) / s.epochs
            rate = max(s.least_rate, s.rate - (s.rate - s.least_rate) * done)
            drawn = np.searchsorted(self.noise, rng.random((len(at), s.negative)), side="right")
            context = tokens[place[at]]
            descend(self.inner, self.outer, context, used[at], tokens[at], drawn, rate)
            self.touched[0] += np.bincount(context[used[at]], minlength=len(self.inner))
            self.touched[1] += np.bincount(np.append(tokens[at], drawn), minlength=len(self.inner))

    def made(self) -> Iterator[pa.RecordBatch]:
        """The rows it touched, in parts."""
        size = _rows_per_body(self.s.dim)
        for matrix, values in enumerate((self.inner, self.outer)):
            for part, begin in enumerate(range(0, len(values), size)):
                weight = self.touched[matrix, begin : begin + size]
                if weight.any():
                    yield _body(matrix, part, self.number, weight, values[begin : begin + size] * weight[:, None])


def _pieces(batches: Iterator[pa.RecordBatch], sentences: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows): each shard's rows in order, so many at a time wherever Arrow batches end."""
    held: list[pa.RecordBatch] = []
    open_ = -1

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        shards = np.asarray(batch.column(2))
        cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            while begin < end:
                if held and (shards[begin] != open_ or sum(b.num_rows for b in held) >= sentences):
                    yield open_, joined()
                    held = []
                open_ = int(shards[begin])
                room = sentences - sum(b.num_rows for b in held)
                held.append(batch.slice(begin, min(room, end - begin)))
                begin += held[-1].num_rows
    if held:
        yield open_, joined()


def _trainer(shared, epoch: int, s: Settings):
    """Trains the shards of one partition, rows (ids, share, shard) in order."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for number, rows in _pieces((b for b in batches if b.num_rows), SENTENCES):
            if shard is None or shard.number != number:
                if shard is not None:
                    yield from shard.made()
                shard = _Shard(number, shared.value, epoch, s)
            shard.train(rows)
        if shard is not None:
            yield from shard.made()

    return train


def _body(matrix: int, part: int, shard: int, weight: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([matrix], pa.int32()),
            pa.array([part], pa.int32()),
            pa.array([shard], pa.int32()),
            pa.array([weight.astype(np.float64).tobytes()], pa.binary()),
            pa.array([total.astype(np.float64).tobytes()], pa.binary()),
        ],
        ["matrix", "part", "shard", "weight", "total"],
    )


def _summed(sent: DataFrame) -> DataFrame:
    """Sums of the bodies of one part, ``BRANCH`` shards at a time, then of those."""

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        weight, total = (
            np.sum([np.frombuffer(b.as_py(), np.float64) for b in table.column(c)], axis=0) for c in ("weight", "total")
        )
        first = [table.column(c)[0].as_py() for c in ("matrix", "part", "shard")]
        return pa.Table.from_batches([_body(*first, weight, total)])

    some = sent.withColumn("shard_group", F.floor(F.col("shard") / BRANCH)).groupBy("matrix", "part", "shard_group")
    return some.applyInArrow(lambda t: summed(t.drop_columns("shard_group")), _BODY).groupBy("matrix", "part").applyInArrow(summed, _BODY)


# --- the whole ---------------------------------------------------------------------------


def token_counts(sentences: DataFrame, column: str = "sentence", min_count: int = 1) -> DataFrame:
    """``(token, n)`` of the tokens that occur ``min_count`` times."""
    found = sentences.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return found.filter(F.col("token").isNotNull() & (F.col("n") >= min_count))


def noise_table(counts: DataFrame, power: float = NOISE_POWER) -> DataFrame:
    """``(token, n, share)``: how likely a token is drawn as noise, by its count to ``power``."""
    weight = F.pow(F.col("n").cast("double"), F.lit(power))
    total = counts.agg(F.sum(weight).alias("whole"))
    return counts.crossJoin(F.broadcast(total)).select("token", "n", (weight / F.col("whole")).alias("share"))


def kept_share(n: np.ndarray, sample: float) -> np.ndarray:
    """How likely a token of each count stays when frequent ones are thinned out."""
    if not sample or not len(n):
        return np.ones(len(n))
    bar = sample * n.sum()
    return np.minimum(1, (np.sqrt(n / bar) + 1) * bar / n)


def train_cbow(sentences: DataFrame, column: str = "sentence", settings: Settings = Settings()) -> DataFrame:
    """``(token, n, vector)`` of every token of the sentences, strings or numbers.

    The vocabulary times ``dim`` may be ``MOST_VALUES`` at most, as every task holds it.
    """
    s, spark = settings, sentences.sparkSession
    kind = dict(token_counts(sentences, column).dtypes)["token"]
    schema = f"token {kind}, n long, vector array<float>"
    with scratch(spark, "cbow") as tables:
        rows = tables.table(sentences.select(F.col(column).alias("sentence")).filter(F.size("sentence") > 0), "sentences")
        counts = token_counts(rows, min_count=s.min_count)
        if not at_most(counts, MOST_VALUES // s.dim):
            raise ValueError(f"vocabulary times dim is above {MOST_VALUES}")
        # bounded by the vocabulary
        known = sorted(((r["token"], r["n"]) for r in counts.collect()), key=lambda x: (-x[1], str(x[0])))
        if not known:
            return spark.createDataFrame([], schema)
        n = np.array([k for _, k in known], np.float64)
        noise = np.cumsum(n**NOISE_POWER)
        noise /= noise[-1]
        noise[-1] = 1.0
        ids = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(known)], f"token {kind}, id int")
        shards = tables.table(_sharded(rows, ids, s.shards), "shards")
        inner, outer = _start(len(known), s)
        size = _rows_per_body(s.dim)
        for epoch in range(s.epochs):
            shared = spark.sparkContext.broadcast((inner, outer, kept_share(n, s.sample), noise))
            # by number: ranges of few keys put two shards into one task and leave another empty
            dealt = shards.repartitionById(s.shards, F.col("shard")).sortWithinPartitions("shard", "share", "digest")
            sent = dealt.select("ids", "share", "shard").mapInArrow(_trainer(shared, epoch, s), _BODY)
            inner, outer = inner.copy(), outer.copy()
            for r in _summed(sent).toLocalIterator():
                weight = np.frombuffer(r["weight"], np.float64)
                total = np.frombuffer(r["total"], np.float64).reshape(-1, s.dim)
                hit, begin = weight > 0, r["part"] * size
                (inner, outer)[r["matrix"]][begin + np.flatnonzero(hit)] = total[hit] / weight[hit][:, None]
            shared.unpersist()
        found = pa.table(
            {
                "token": [t for t, _ in known],
                "n": pa.array(n.astype(np.int64)),
                "vector": pa.FixedSizeListArray.from_arrays(pa.array(inner.ravel()), s.dim).cast(pa.list_(pa.float32())),
            }
        )
        return spark.createDataFrame(found).select(F.col("token").cast(kind).alias("token"), "n", "vector")


def _sharded(rows: DataFrame, ids: DataFrame, shards: int) -> DataFrame:
    """``(ids, shard, share, digest)`` of each sentence; tokens outside the vocabulary left out.

    ``share`` is how far down its shard a sentence stands, by the order of digests.
    """
    if ids.count() <= 1_000_000:
        # numbers of a vocabulary: bounded like the vectors
        held = rows.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in ids.collect()})

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                out, digests = [], []
                for tokens in batch.column(0).to_pylist():
                    found = [known[t] for t in tokens if t in known]
                    out.append(found)
                    digests.append(hashlib.md5(np.array(found, np.int32).tobytes()).hexdigest())
                yield pa.record_batch([pa.array(out, pa.list_(pa.int32())), pa.array(digests, pa.string())], ["ids", "digest"])

        coded = rows.mapInArrow(numbered, "ids array<int>, digest string")
    else:
        places = rows.select(F.monotonically_increasing_id().alias("row"), F.posexplode("sentence").alias("pos", "token"))
        found = places.join(ids, "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
        coded = found.select(F.transform("x", lambda p: p["id"]).alias("ids"))
        coded = coded.withColumn("digest", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")))
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    share = F.conv(F.substring("digest", 9, 8), 16, 10).cast("double") / float(1 << 32)
    return coded.filter(F.size("ids") > 1).select("ids", (number % shards).cast("int").alias("shard"), share.alias("share"), "digest")
