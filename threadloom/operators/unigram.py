"""Unigram subword vocabularies: learning by expectation-maximisation, and best-path segmentation.

A word is segmented into pieces of a vocabulary; a segmentation's probability is
the product of its pieces'. Learning starts from frequent substrings and
alternates two steps over the distinct words, which never leave their tasks:
expected counts of pieces over the lattices of all segmentations, and
pruning of the pieces whose loss lowers the likelihood least. What tasks
send is one number per piece; pieces are bounded by ``seed_size``.

Sums do not depend on how words are partitioned: expected counts are kept in
units of 2**-16, and best paths use scores in millionths, as whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.session import at_most, parallelism, scratch

LONGEST_PIECE = 16
SEEDS_PER_ENTRY = 10
SUB_ITERATIONS = 2
SHRINK = 0.75
HEADROOM = 1.1
LEAST_EXPECTED = 0.5
UNIT = 1 << 16
MICRO = 1_000_000
SHARED_PIECES = 1_000_000
_BLOCK_CELLS = 1 << 20
_SEEN = 1 << 20
_NONE = -(1 << 60)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PIECES = "piece string, score long"


# --- lattices of many words at once ---------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each, padded with 0, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    grid = np.zeros((len(words), int(sizes.max(initial=0))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    grid[np.arange(grid.shape[1]) < sizes[:, None]] = flat
    return grid, sizes


def _letter(codes: np.ndarray) -> np.ndarray:
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def _prefixes(codes: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * np.uint64(base) + codes[:, k]
    return out


def _spans(prefix: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every run of ``n`` letters."""
    return prefix[:, n:] - prefix[:, : prefix.shape[1] - n] * np.uint64(pow(base, n, 1 << 64))


@dataclass
class Lookup:
    """Piece numbers by 128-bit hash; small enough for every task to hold."""

    keys: np.ndarray
    checks: np.ndarray
    numbers: np.ndarray
    longest: int
    seen: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> Lookup:
        grid, sizes = _codes(pieces)
        letters = _letter(grid)
        rows = np.arange(len(pieces))
        keys, checks = (_prefixes(letters, b)[rows, sizes] for b in _BASES)
        # runs of different lengths may share a hash value only by chance
        order = np.argsort(keys, kind="stable")
        # low bits of the keys: most runs are no piece and are told by one look at these
        seen = np.zeros(_SEEN, bool)
        seen[(keys % np.uint64(_SEEN)).astype(np.int64)] = True
        return cls(keys[order], checks[order], order, int(sizes.max(initial=0)), seen)

    def edges(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``[word, start, length - 1]``: number of the piece that stands there, else -1."""
        words, width = grid.shape
        out = np.full((words, width, self.longest), -1, np.int64)
        letters = _letter(grid)
        first, second = (_prefixes(letters, b) for b in _BASES)
        for n in range(1, min(self.longest, width) + 1):
            keys = _spans(first, n, _BASES[0])
            maybe = self.seen[(keys % np.uint64(_SEEN)).astype(np.int64)]
            maybe &= np.arange(n, width + 1) <= sizes[:, None]
            word, start = np.nonzero(maybe)
            keys = keys[word, start]
            checks = second[word, start + n] - second[word, start] * np.uint64(pow(_BASES[1], n, 1 << 64))
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            fits = (self.keys[at] == keys) & (self.checks[at] == checks)
            out[word[fits], start[fits], n - 1] = self.numbers[at[fits]]
        return out


def _blocks(words: list[str], longest: int) -> Iterator[np.ndarray]:
    """Positions of words of about one length, so that a block's lattice stays small."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        # the block ends where its longest word would make it too large
        ahead = sizes[order[begin:]] * longest * np.arange(1, len(order) - begin + 1)
        stop = begin + max(1, int(np.searchsorted(ahead, _BLOCK_CELLS, side="right")))
        yield order[begin:stop]
        begin = stop


def _summed_logs(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))


def expected_counts(words: list[str], n: np.ndarray, lookup: Lookup, logs: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of ``n`` of each word, in units."""
    total = np.zeros(len(logs), np.int64)
    padded = np.append(logs, -np.inf)
    for block in _blocks(words, lookup.longest):
        grid, sizes = _codes([words[k] for k in block])
        edges = lookup.edges(grid, sizes)
        count, width = grid.shape
        weight = padded[edges]
        ahead = np.full((count, width + 1), -np.inf)
        ahead[:, 0] = 0.0
        for end in range(1, width + 1):
            back = np.arange(1, min(lookup.longest, end) + 1)
            ahead[:, end] = _summed_logs(ahead[:, end - back] + weight[:, end - back, back - 1])
        behind = np.full((count, width + 1), -np.inf)
        behind[np.arange(count), sizes] = 0.0
        for start in range(width - 1, -1, -1):
            on = np.arange(1, min(lookup.longest, width - start) + 1)
            terms = _summed_logs(behind[:, start + on] + weight[:, start, on - 1])
            behind[:, start] = np.where(start < sizes, terms, behind[:, start])
        word, start, step = np.nonzero(edges >= 0)
        log = ahead[word, start] + weight[word, start, step] + behind[word, start + step + 1] - behind[word, 0]
        units = np.rint(n[block][word] * np.exp(log) * UNIT)
        total += np.bincount(edges[word, start, step], units, minlength=len(logs)).astype(np.int64)
    return total


def best_paths(
    words: list[str], lookup: Lookup, scores: np.ndarray, without_whole: bool = False
) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of the best segmentation of each word, and its score.

    Of equal scores the one with the longest last piece wins, at every end. A
    character outside the vocabulary is piece -1 and scores far below all
    pieces. ``without_whole`` leaves out the piece that is the whole word.
    """
    paths: list = [None] * len(words)
    found = np.zeros(len(words), np.int64)
    padded = np.append(scores.astype(np.int64), _NONE)
    unknown = int(scores.min(initial=0)) - 10 * MICRO
    for block in _blocks(words, lookup.longest):
        grid, sizes = _codes([words[k] for k in block])
        edges = lookup.edges(grid, sizes)
        count, width = grid.shape
        rows = np.arange(count)
        if without_whole:
            fits = sizes <= lookup.longest
            edges[rows[fits], 0, sizes[fits] - 1] = -1
        weight = padded[edges]
        if not without_whole and width:
            weight[:, :, 0] = np.where(edges[:, :, 0] < 0, unknown, weight[:, :, 0])
        best = np.full((count, width + 1), _NONE)
        best[:, 0] = 0
        step = np.zeros((count, width + 1), np.int64)
        for end in range(1, width + 1):
            # longest first: argmax takes the first of equals
            back = np.arange(min(lookup.longest, end), 0, -1)
            terms = np.maximum(best[:, end - back] + weight[:, end - back, back - 1], _NONE)
            at = terms.argmax(axis=1)
            best[:, end], step[:, end] = terms[rows, at], back[at]
        found[block] = best[rows, sizes]
        at, live, made = sizes.copy(), sizes > 0, []
        while live.any():
            size = step[rows, at]
            begin = at - size
            made.append(np.where(live, edges[rows, np.maximum(begin, 0), np.maximum(size - 1, 0)], -2))
            at = np.where(live, begin, at)
            live = at > 0
        steps = np.array(made[::-1], np.int64).reshape(len(made), count)
        for k, word in enumerate(block):
            column = steps[:, k]
            paths[word] = column[column > -2]
    return paths, found


# --- learning --------------------------------------------------------------------


def seed_pieces(counts: DataFrame, size: int, longest: int = LONGEST_PIECE, least: int = 2) -> DataFrame:
    """``(piece, n, gain)``: all characters, and the ``size`` best substrings of ``(word, n)`` rows.

    A substring of 2 to ``longest`` characters counts if it occurs ``least`` times;
    its gain is occurrences times length, a character's its occurrences.
    """
    parts = F.expr(
        "flatten(transform(sequence(1, length(word)), i -> transform("
        f"sequence(1, least({longest}, length(word) - i + 1)), l -> substring(word, i, l))))"
    )
    found = counts.filter("length(word) > 0").select(F.explode(parts).alias("piece"), "n")
    summed = found.groupBy("piece").agg(F.sum("n").alias("n"))
    summed = summed.withColumn("gain", F.col("n") * F.length("piece"))
    single = F.length("piece") == 1
    top = summed.filter(~single & (F.col("n") >= least)).orderBy(F.desc("gain"), "piece").limit(size)
    return summed.filter(single).unionByName(top)


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), np.zeros(len(x))
    for _ in range(7):
        small = x < 7
        out[small] -= 1 / x[small]
        x[small] += 1
    x -= 0.5
    y = 1 / (x * x)
    return out + np.log(x) + y / 24 - 7 * y**2 / 960 + 31 * y**3 / 8064 - 127 * y**4 / 30720


def estimated(units: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces stay after an expectation step, and the log probabilities of those.

    Pieces expected less than half a time go; characters stay, counted as half at least.
    """
    expected = units / UNIT
    stays = single | (expected >= LEAST_EXPECTED)
    kept = np.maximum(expected[stays], LEAST_EXPECTED)
    return stays, digamma(kept) - digamma(np.array([kept.sum()]))[0]


def losses(pieces: list[str], logs: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces must stay, and the drop in likelihood per word if a piece goes.

    ``used`` is how often the best paths of all words use each piece; without a
    piece, its words take the piece's own second-best segmentation. Pieces that are
    not their own best segmentation, or are never used, lose nothing (-inf).
    """
    lookup = Lookup.of(pieces)
    scores = np.rint(logs * MICRO).astype(np.int64)
    others, score = best_paths(pieces, lookup, scores, without_whole=True)
    single = np.array([len(p) == 1 for p in pieces])
    stays = single | (score <= _NONE // 2)
    total = max(1.0, float(used.sum()))
    loss = np.full(len(pieces), -np.inf)
    for k in np.flatnonzero(~stays & (used > 0) & (scores > score)):
        after = np.log(total + used[k] * (len(others[k]) - 1))
        alternative = (np.log(used[others[k]] + used[k]) - after).sum()
        loss[k] = used[k] / total * (np.log(used[k]) - np.log(total) - alternative)
    return stays, loss


def pruned(pieces: list[str], logs: np.ndarray, used: np.ndarray, target: int) -> np.ndarray:
    """Positions of the pieces that stay: three quarters of them, or ``target`` if that is more."""
    stays, loss = losses(pieces, logs, used)
    room = max(target, int(SHRINK * len(pieces))) - int(stays.sum())
    order = sorted(np.flatnonzero(~stays & np.isfinite(loss)).tolist(), key=lambda k: (-loss[k], pieces[k]))
    return np.sort(np.concatenate([np.flatnonzero(stays), np.array(order[: max(0, room)], np.int64)]))


def _per_piece(
    words: DataFrame, pieces: list[str], values: np.ndarray, count: Callable
) -> np.ndarray:
    """Sum over all words of ``count(words, n, lookup, values)``, one whole number per piece."""
    shared = words.sparkSession.sparkContext.broadcast((Lookup.of(pieces), values))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, values = shared.value
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            total += count(batch.column(0).to_pylist(), np.asarray(batch.column(1)).astype(float), lookup, values)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "total"])

    rows = words.select("word", "n").mapInArrow(summed, "at int, total long").groupBy("at").agg(F.sum("total").alias("total"))
    out = np.zeros(len(pieces), np.int64)
    # one row per piece: at most ``seed_size`` and the characters
    for row in rows.collect():
        out[row["at"]] = row["total"]
    shared.unpersist()
    return out


def _path_uses(words: list[str], n: np.ndarray, lookup: Lookup, logs: np.ndarray) -> np.ndarray:
    paths, _ = best_paths(words, lookup, np.rint(logs * MICRO).astype(np.int64))
    flat = np.concatenate([np.zeros(0, np.int64), *paths])
    times = np.repeat(n, [len(p) for p in paths])
    known = flat >= 0
    return np.bincount(flat[known], times[known], minlength=len(logs)).astype(np.int64)


def learn_unigram(
    counts: DataFrame,
    pieces: int,
    seed_size: int | None = None,
    longest: int = LONGEST_PIECE,
) -> DataFrame:
    """The ``pieces`` best pieces of ``(word, n)`` rows with scores in millionths of a nat.

    All characters are among them, also if they are more than ``pieces``.
    ``seed_size`` bounds what learning starts from (ten per piece by default) and
    with it all that the driver and a task hold of the model.
    """
    spark = counts.sparkSession
    with scratch(spark, "unigram") as tables:
        words = counts.filter("length(word) > 0 and n > 0").select("word", "n")
        words = tables.table(words.repartition(parallelism(spark), "word"), "words")
        found = seed_pieces(words, seed_size or SEEDS_PER_ENTRY * pieces, longest).collect()
        found = sorted(found, key=lambda r: (-r["gain"], r["piece"]))
        names = [r["piece"] for r in found]
        gains = np.array([r["gain"] for r in found], float)
        logs = np.log(gains) - np.log(gains.sum()) if names else gains
        target = int(np.ceil(HEADROOM * pieces))
        while names:
            for _ in range(SUB_ITERATIONS):
                units = _per_piece(words, names, logs, expected_counts)
                stays, logs = estimated(units, np.array([len(p) == 1 for p in names]))
                names = [p for p, s in zip(names, stays, strict=True) if s]
            if len(names) <= target:
                break
            kept = pruned(names, logs, _per_piece(words, names, logs, _path_uses), target)
            if len(kept) == len(names):
                break
            names, logs = [names[k] for k in kept], logs[kept]
        order = sorted(range(len(names)), key=lambda k: (len(names[k]) > 1, -logs[k], names[k]))
        chosen = order[: max(pieces, sum(len(p) == 1 for p in names))]
        rows = [(names[k], int(np.rint(logs[k] * MICRO))) for k in chosen]
        return spark.createDataFrame(rows, PIECES)


def unigram_vocabulary(pieces: DataFrame) -> DataFrame:
    """``(subword, id, score)``: specials, protected placeholders, pieces by score.

    Its size is that of the vocabulary, so one window numbers it.
    """
    spark = pieces.sparkSession
    protected = [p.strip() for p in V.PLACEHOLDERS if p.strip()]
    fixed = [(0, i, s) for i, s in enumerate(V.BASE_SPECIALS)] + [(1, i, s) for i, s in enumerate(protected)]
    head = spark.createDataFrame(fixed, "kind int, place long, subword string").withColumn("score", F.lit(0).cast("long"))
    tail = pieces.select(F.lit(2).alias("kind"), (-F.col("score")).alias("place"), F.col("piece").alias("subword"), "score")
    tail = tail.filter(~F.col("subword").isin(*V.BASE_SPECIALS, *protected))
    order = Window.orderBy("kind", "place", "subword")
    return head.unionByName(tail).select("subword", (F.row_number().over(order) - 1).alias("id"), "score")


def learn_unigram_vocabulary(counts: DataFrame, vocab_size: int = V.SUBWORD_VOCABULARY_SIZE, seed_size: int | None = None) -> DataFrame:
    """A vocabulary of ``vocab_size`` entries, specials and protected placeholders included."""
    fixed = len(V.BASE_SPECIALS) + sum(bool(p.strip()) for p in V.PLACEHOLDERS)
    return unigram_vocabulary(learn_unigram(counts, vocab_size - fixed, seed_size))


# --- segmentation -------------------------------------------------------------------


def _segmented(shared) -> Callable:
    """Rows (word) to rows (word, ids) by the broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, ids, scores = shared.value
        padded = np.append(ids, V.UNKNOWN_ID)
        for batch in batches:
            words = batch.column(0).to_pylist()
            paths, _ = best_paths(words, lookup, scores)
            flat = padded[np.concatenate([np.zeros(0, np.int64), *paths])]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([batch.column(0), made], ["word", "ids"])

    return run


def _by_lattice_join(words: DataFrame, vocab: DataFrame, longest: int) -> DataFrame:
    """The same for a vocabulary of any size: the pieces inside each word are joined to it."""
    starts = f"sequence(1, least({longest}, length(word) - i + 1))"
    parts = F.expr(
        f"flatten(transform(sequence(1, length(word)), i -> transform({starts}, l -> struct(i, l, substring(word, i, l) as piece))))"
    )
    spans = words.filter("length(word) > 0").select("word", F.explode(parts).alias("span")).select("word", "span.*").toDF("word", "i", "l", "piece")
    found = spans.join(vocab.select(F.col("subword").alias("piece"), "id", "score"), "piece")
    lowest = vocab.agg(F.min("score")).first()[0] or 0
    edges = found.groupBy("word").agg(F.collect_list(F.struct("i", "l", "id", "score")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = lowest - 10 * MICRO
        for batch in batches:
            out = []
            for word, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at: dict[int, list] = {}
                for e in edges or ():
                    at.setdefault(e["i"] - 1 + e["l"], []).append((e["score"], e["l"], e["id"]))
                best, back = [0] + [_NONE] * len(word), [(0, 0)] * (len(word) + 1)
                for end in range(1, len(word) + 1):
                    offers = [(best[end - n] + s, n, i) for s, n, i in at.get(end, ())]
                    if not any(n == 1 for _, n, _ in offers):
                        offers.append((best[end - 1] + unknown, 1, V.UNKNOWN_ID))
                    top = max(offers)
                    best[end], back[end] = top[0], top[1:]
                path, end = [], len(word)
                while end:
                    n, i = back[end]
                    path.append(i)
                    end -= n
                out.append(path[::-1])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["word", "ids"])

    joined = words.join(edges, "word", "left").select("word", "edges")
    return joined.mapInArrow(run, "word string, ids array<int>")


def segment_words(words: DataFrame, vocab: DataFrame, shared_pieces: int = SHARED_PIECES) -> DataFrame:
    """``(word, ids)``: the best segmentation of each word by a vocabulary ``(subword, id, score)``.

    Specials and placeholders of the vocabulary are never part of a word; a
    character that no piece covers is id 0. A vocabulary of at most
    ``shared_pieces`` goes to every task; a larger one is joined to the substrings
    of the words. Both give the same.
    """
    spark = vocab.sparkSession
    fixed = [*V.BASE_SPECIALS, *[p.strip() for p in V.PLACEHOLDERS]]
    usable = vocab.filter((F.length("subword") > 0) & ~F.col("subword").isin(*fixed))
    words = words.select("word")
    if at_most(usable, shared_pieces):
        rows = usable.collect()
        lookup = Lookup.of([r["subword"] for r in rows] or ["\0"])
        ids = np.array([r["id"] for r in rows] or [V.UNKNOWN_ID], np.int64)
        scores = np.array([r["score"] for r in rows] or [0], np.int64)
        shared = spark.sparkContext.broadcast((lookup, ids, scores))
        return words.mapInArrow(_segmented(shared), "word string, ids array<int>")
    longest = usable.agg(F.max(F.length("subword"))).first()[0]
    return _by_lattice_join(words, usable, longest)
