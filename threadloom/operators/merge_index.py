"""Learning byte-pair merges with an index from pairs to the words that hold them.

Words never change: a word's symbols at any time follow from the merges so far.
The index has a row for each word and each two letters side by side in it. Two
symbols can only meet at such a junction, the last letter of one and the first of
the other, so a round reads the index rows of its pairs' junctions, keeps the words
that hold the pairs' letters in a row, replays those words, and sends what changed
as counts per pair of symbols. Nothing is written in a round.

Index files are dealt by word and sorted by junction: each task has its share
of every junction, however frequent, and skips the pages of all others.

The driver holds the most frequent pairs with exact counts and a bound that no
other pair exceeds, both kept up by the count changes. When the bound no longer
tells pairs apart, the top is read again from the written counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch, parallelism, scratch

TRACKED = 65_536
INDEX_BYTES = 64 << 20
#: Merges up to which all words of a batch are replayed at once, one replacement per merge.
REPLACED = 256
_CHANGES = "left string, right string, change long"


class Pair(NamedTuple):
    left: str
    right: str
    n: int


# --- symbols of words ----------------------------------------------------------


def replayed(symbols: list[str], ranks: dict[tuple[str, str], list[int]], after: int = -1) -> list[str]:
    """``symbols`` after all merges of a rank above ``after``, each applied once, in order."""
    while len(symbols) > 1:
        best = None
        for pair in zip(symbols, symbols[1:]):
            for rank in ranks.get(pair, ()):
                if rank > after and (best is None or rank < best[0]):
                    best = (rank, pair)
        if best is None:
            break
        after, (left, right) = best
        out, i = [], 0
        while i < len(symbols):
            if symbols[i] == left and i + 1 < len(symbols) and symbols[i + 1] == right:
                out.append(left + right)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def ranked(merges: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    out: dict[tuple[str, str], list[int]] = {}
    for rank, pair in enumerate(merges):
        out.setdefault(pair, []).append(rank)
    return out


def _spaced(words: pa.Array) -> pa.Array:
    """Every character between blanks of its own."""
    return pc.replace_substring_regex(words, "(?s)(.)", r" \1 ")


def _merged(forms: pa.Array, merges: list[tuple[str, str]]) -> pa.Array:
    for left, right in merges:
        forms = pc.replace_substring(forms, f" {left}  {right} ", f" {left}{right} ")
    return forms


def _forms(words: pa.Array, merges: list[tuple[str, str]]) -> pa.Array:
    """Symbols of words after the merges, each between blanks."""
    if len(merges) <= REPLACED:
        return _merged(_spaced(words), merges)
    ranks = ranked(merges)
    return pa.array(["".join(f" {s} " for s in replayed(list(w), ranks)) for w in words.to_pylist()], pa.string())


def _pairs_of(forms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All symbols, the word each stands in, and how many symbols each word has."""
    lists = pc.split_pattern(pc.utf8_trim(forms, " "), "  ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(sizes)), sizes), sizes


def _changes(words: pa.Array, n: pa.Array, old: list, new: list) -> pa.RecordBatch:
    """What the new merges change in the words: pairs with the change of their count."""
    before = _forms(words, old)
    after = _merged(before, new)
    touched = pc.not_equal(before, after)
    words, n, before, after = (x.filter(touched) for x in (words, n, before, after))
    sides = [_pairs_of(x) for x in (before, after)]
    symbols = pa.concat_arrays([s for s, _, _ in sides]).dictionary_encode()
    names, codes = symbols.dictionary, symbols.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.concatenate([o for _, o, _ in sides])
    is_after = np.repeat([False, True], [len(s) for s, _, _ in sides])
    inside = (owner[1:] == owner[:-1]) & (is_after[1:] == is_after[:-1])
    d = max(1, len(names))
    key = (codes[:-1] * d + codes[1:])[inside]
    weight = n.to_numpy(zero_copy_only=False).astype(np.int64)[owner[:-1][inside]]
    weight = np.where(is_after[:-1][inside], weight, -weight)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found, change = key[starts], np.add.reduceat(weight, starts) if len(key) else weight
    found, change = found[change != 0], change[change != 0]
    return pa.record_batch(
        [names.take(pa.array(found // d)), names.take(pa.array(found % d)), pa.array(change, pa.int64())],
        ["left", "right", "change"],
    )


# --- the index -----------------------------------------------------------------------


_LETTERS = (
    "transform(sequence(1, length(word) - 1),"
    " i -> struct(substring(word, i, 1) as left, substring(word, i + 1, 1) as right))"
)


def _written(words: DataFrame, tables: Scratch) -> DataFrame:
    """Rows (left, right, word, n): words under their junctions, sorted by these within each file."""
    size = words.agg(F.sum(F.length("word").cast("long") * (F.length("word") + 12))).first()[0] or 0
    tasks = max(parallelism(words.sparkSession), -(-size // INDEX_BYTES))
    rows = words.repartition(tasks, "word").filter("length(word) > 1")
    rows = rows.select(F.explode(F.array_distinct(F.expr(_LETTERS))).alias("pair"), "word", "n")
    return tables.table(rows.select("pair.*", "word", "n").sortWithinPartitions("left", "right"), "index")


def _words_of(index: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(word, n)`` of every word that holds the letters of one of the pairs in a row, once."""
    junctions = list(dict.fromkeys((left[-1], right[0]) for left, right in pairs))
    some = F.lit(False)
    for left, right in junctions:
        some = some | ((F.col("left") == F.lit(left)) & (F.col("right") == F.lit(right)))
    # a word under several junctions is read at that of the first pair it holds
    place = F.lit(-1)
    for left, right in reversed(pairs):
        place = F.when(F.contains("word", F.lit(left + right)), junctions.index((left[-1], right[0]))).otherwise(place)
    here = F.lit(-2)
    for k, (left, right) in enumerate(junctions):
        here = F.when((F.col("left") == F.lit(left)) & (F.col("right") == F.lit(right)), k).otherwise(here)
    return index.filter(some).filter(place == here).select("word", "n")


class _Top:
    """The most frequent pairs with exact counts, and a bound for all others."""

    def __init__(self, counts: DataFrame, tables: Scratch, tracked: int) -> None:
        self.tables, self.tracked = tables, tracked
        self.counts = tables.table(counts, "pair-counts")
        self.moved: dict[tuple[str, str], int] = {}
        self._read()

    def _read(self) -> None:
        rows = self.counts.orderBy(F.desc("n"), "left", "right").limit(self.tracked + 1).collect()
        self.bound = rows[self.tracked]["n"] if len(rows) > self.tracked else 0
        self.held = {(r["left"], r["right"]): r["n"] for r in rows[: self.tracked]}
        self.fresh = True

    def read_again(self) -> None:
        """Bring the written counts up to date and read their top."""
        spark = self.counts.sparkSession
        moved = [(left, right, n) for (left, right), n in self.moved.items() if n]
        changes = spark.createDataFrame(moved, "left string, right string, n long")
        summed = self.counts.union(changes).groupBy("left", "right").agg(F.sum("n").alias("n"))
        old, self.counts = self.counts, self.tables.table(summed.filter("n > 0"), "pair-counts")
        self.tables.drop(old)
        self.moved = {}
        self._read()

    def first(self, k: int) -> list[Pair]:
        """The ``k`` most frequent pairs, pair text breaking ties."""

        def best() -> list[Pair]:
            above = (Pair(*p, n) for p, n in self.held.items() if n > (0 if self.fresh else self.bound))
            return heapq.nsmallest(k, above, key=lambda p: (-p.n, p.left, p.right))

        found = best()
        if len(found) < k and self.bound and not self.fresh:
            self.read_again()
            found = best()
        return found

    def move(self, changes: list, new: set[str]) -> None:
        """Take in count changes; ``new`` are symbols that did not exist before."""
        self.fresh = False
        unsure = False
        for r in changes:
            pair, change = (r["left"], r["right"]), r["change"]
            self.moved[pair] = self.moved.get(pair, 0) + change
            if pair in self.held:
                self.held[pair] += change
                if not self.held[pair]:
                    del self.held[pair]
            elif change > 0:
                # without a bound, or with a new symbol, the pair had no occurrence before
                if not self.bound or new & set(pair):
                    self.held[pair] = change
                else:
                    unsure = True
        if unsure or len(self.held) > 4 * self.tracked:
            self.read_again()


def learn(
    counts: DataFrame, merges: int, per_round: int, choose: Callable[[list, int], list], tracked: int = TRACKED
) -> list[tuple[str, str]]:
    """The first ``merges`` merges of ``(word, n)`` rows; ``choose`` picks those that share a round."""
    spark = counts.sparkSession
    learned: list[tuple[str, str]] = []
    symbols: set[str] = set()
    with scratch(spark, "merges") as tables:
        words = tables.table(counts.select("word", "n"), "words")
        index = _written(words, tables)
        single = words.filter("length(word) > 1").select(F.explode(F.expr(_LETTERS)).alias("pair"), "n")
        summed = single.groupBy("pair").agg(F.sum("n").alias("n")).select("pair.left", "pair.right", "n")
        top = _Top(summed, tables, tracked)
        while len(learned) < merges:
            limit = min(per_round, merges - len(learned))
            new = [(p.left, p.right) for p in choose(top.first(limit + 1), limit)]
            old = list(learned)
            learned += new
            if not new or len(learned) >= merges:
                break

            def update(batches: Iterator[pa.RecordBatch], old=old, new=new) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _changes(batch.column(0), batch.column(1), old, new)

            sent = _words_of(index, new).mapInArrow(update, _CHANGES)
            changes = sent.groupBy("left", "right").agg(F.sum("change").alias("change")).filter("change != 0")
            made = {left + right for left, right in new}
            # rows per pair of symbols that a merge touches: bounded by the vocabulary
            top.move(changes.collect(), made - symbols)
            symbols |= made
    return learned
