"""Subword vocabularies by byte-pair merging, and encoding turns with them."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.operators import merge_index
from threadloom.session import at_most, broadcast_if_small, materialize

WORD_START = "▁"
MERGES = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()),
    ]
)
LARGEST_VOCABULARY = 1_000_000
#: Characters of the words, and of the turns, that a task keeps with their ids.
CACHED_CHARACTERS = 1 << 22
#: Bytes of turns that a task encodes at a time.
SLICE_BYTES = 1 << 22
PLACEHOLDER = re.compile(r"(<\w+>)")
WORD = re.compile(r"[^ \n]+")


def word_counts(corpus: DataFrame, column: str = "text") -> DataFrame:
    """Words outside placeholders, marked at their start, with their counts."""
    found = F.flatten(F.transform(X.text_pieces(column), X.words))
    counted = corpus.select(F.explode(found).alias("bare")).groupBy("bare").count()
    return counted.select(
        F.concat(F.lit(WORD_START), "bare").alias("word"), F.col("count").alias("n")
    )


def spaced(word: Column | str) -> Column:
    """Every symbol between blanks of its own, so a merge is a plain replace."""
    return F.regexp_replace(X._col(word), "(?s)(.)", " $1 ")


def adjacent_pairs(form: Column | str) -> Column:
    """Neighbouring symbols of a spaced word as structs (left, right)."""
    parts = F.split(F.btrim(X._col(form)), "  ")
    return F.arrays_zip(
        F.slice(parts, F.lit(1), F.size(parts) - 1).alias("left"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).alias("right"),
    )


def _summed(pairs: DataFrame) -> DataFrame:
    """``(pair, n)`` rows to ``(left, right, n)``, leaving out what cancels."""
    return (
        pairs.groupBy(F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )


def pair_counts(symbols: DataFrame) -> DataFrame:
    """Adjacent symbol pairs of ``(spaced, n)`` rows, weighted by word count."""
    return _summed(symbols.select(F.explode(adjacent_pairs("spaced")).alias("pair"), "n"))


def disjoint_pairs(pairs: list, limit: int) -> list:
    """Top pairs without common symbols, passing over those that share one."""
    seen: set[str] = set()
    chosen = []
    for p in pairs[:limit]:
        if p.left not in seen and p.right not in seen:
            chosen.append(p)
            seen |= {p.left, p.right}
    return chosen


def safe_prefix(pairs: list, limit: int) -> list:
    """The pairs that one-at-a-time merging would also pick next, in order.

    ``pairs`` are the top pairs by count, at most ``limit + 1`` of them. A merge
    of (a, b) can only lower pairs holding a or b, and any pair it creates is no
    more frequent than one of those. So pairs without common symbols may be
    merged together as long as they are more frequent than the first pair that
    shares a symbol, and than the first one not looked at.
    """
    seen: set[str] = set()
    bound = pairs[limit].n if len(pairs) > limit else 0
    chosen = []
    for p in pairs[:limit]:
        if p.left in seen or p.right in seen:
            bound = max(bound, p.n)
            break
        chosen.append(p)
        seen |= {p.left, p.right}
        if p.left == p.right:
            bound = max(bound, p.n)
            break
    return [p for i, p in enumerate(chosen) if i == 0 or p.n > bound]


def learn_merges(
    counts: DataFrame, merges: int, merges_per_round: int = 64, strict: bool = True
) -> DataFrame:
    """The first ``merges`` merges, ``(rank, left, right)``, over distinct words.

    The most frequent pair is merged first, pair text breaking ties. Several
    merges share a round where that provably changes nothing, so any
    ``merges_per_round`` gives the same result. An index from pairs to words
    lets a round read only the words that hold its pairs (see ``merge_index``);
    its tables are deleted at the end. ``strict=False`` needs far fewer rounds
    for large vocabularies: it merges all top pairs without common symbols, so
    merges of close counts may swap ranks.
    """
    choose = safe_prefix if strict else disjoint_pairs
    learned = merge_index.learn(counts, merges, merges_per_round, choose)
    rows = [(rank, left, right) for rank, (left, right) in enumerate(learned)]
    return counts.sparkSession.createDataFrame(rows, MERGES)


def character_counts(counts: DataFrame) -> DataFrame:
    return (
        counts.select(F.explode(F.split("word", "")).alias("subword"), "n")
        .groupBy("subword")
        .agg(F.sum("n").alias("n"))
    )


def vocabulary(counts: DataFrame, merges: DataFrame) -> DataFrame:
    """Base vocabulary ``(subword, id)``: specials, merged pieces, characters.

    Its size is bounded by the merges and the character set, so one window
    numbers it.
    """
    spark = counts.sparkSession
    specials = spark.createDataFrame(
        [(0, i, s) for i, s in enumerate(V.BASE_SPECIALS)], "kind int, place long, subword string"
    )
    pieces = (
        merges.groupBy(F.concat("left", "right").alias("subword"))
        .agg(F.min("rank").alias("rank"))
        .select(F.lit(1).alias("kind"), F.col("rank").cast("long").alias("place"), "subword")
    )
    characters = character_counts(counts).select(
        F.lit(2).alias("kind"), (-F.col("n")).alias("place"), "subword"
    )
    order = Window.orderBy("kind", "place", "subword")
    return (
        specials.unionByName(pieces)
        .unionByName(characters)
        .select("subword", (F.row_number().over(order) - 1).alias("id"))
    )


def with_placeholders(base: DataFrame) -> DataFrame:
    """Append the six placeholder entries at V .. V+5."""
    last = base.agg(F.max("id").alias("id")).first().id
    size = 0 if last is None else last + 1
    extra = [(token, size + i) for i, token in enumerate(V.PLACEHOLDERS)]
    return base.unionByName(base.sparkSession.createDataFrame(extra, "subword string, id int"))


def learn_subwords(
    corpus: DataFrame,
    column: str = "text",
    vocab_size: int = V.SUBWORD_VOCABULARY_SIZE,
    merges_per_round: int = 64,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Merges and base vocabulary of ``vocab_size`` entries, protected ones included."""
    counts = materialize(word_counts(corpus, column), "words")
    characters = character_counts(counts).count()
    protected = len(V.PLACEHOLDERS) - 1
    room = max(0, vocab_size - len(V.BASE_SPECIALS) - protected - characters)
    merges = learn_merges(counts, room, merges_per_round, strict)
    return merges, vocabulary(counts, merges)


def split_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of one word after all merges, lowest rank first, left to right."""
    symbols: list[str | None] = list(word)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(symbols):
            rank = ranks.get((symbols[i], symbols[j]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, None
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s is not None]


class _Cache:
    """Texts with their ids, emptied when it holds more than ``most`` characters."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.found = most, 0, {}
        self.get = self.found.get

    def put(self, text: str, ids):
        size = len(text) + len(ids) + 16
        if size * 16 <= self.most:
            if self.held + size > self.most:
                self.found.clear()
                self.held = 0
            self.found[text] = ids
            self.held += size
        return ids


def _slices(lists: pa.Array) -> Iterator[pa.Array]:
    """The lists in runs of about ``SLICE_BYTES``, so that what Python holds follows the run."""
    step = max(1, len(lists) * SLICE_BYTES // max(1, lists.nbytes))
    for begin in range(0, len(lists), step):
        yield lists.slice(begin, step)


def _encoded(lists: pa.Array, turn_ids: Callable[[str], np.ndarray]) -> pa.Array:
    """Lists of texts as lists of ids, each distinct text encoded once."""
    texts = lists.flatten().dictionary_encode()
    known = [turn_ids(t) for t in texts.dictionary.to_pylist()]
    bounds = np.cumsum([0, *map(len, known)])
    flat = np.concatenate([np.zeros(0, np.int32), *known])
    coded = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), coded.take(texts.indices), mask=lists.is_null()
    )


class TurnEncoder:
    """Encodes cleaned turns to ids as ``1, pieces and placeholders, id of '', 2``.

    Merges and vocabulary go to the executors once; their size is bounded by
    the vocabulary size. Turns stay where they are: encoding shuffles nothing,
    and a word is split once per task while it stays in the cache.
    ``phone_id="unknown"`` leaves phone placeholders unknown (their key has a
    trailing blank); ``"fixed"`` gives them their own id.
    """

    def __init__(self, merges: DataFrame, base: DataFrame, phone_id: str = "unknown"):
        if not (at_most(merges, LARGEST_VOCABULARY) and at_most(base, LARGEST_VOCABULARY)):
            raise ValueError(f"a vocabulary holds at most {LARGEST_VOCABULARY} entries")
        ids = {r.subword: r.id for r in with_placeholders(base).collect()}
        if phone_id == "fixed":
            ids[V.PHONE_TOKEN.strip()] = ids[V.PHONE_TOKEN]
        ranks = {(r.left, r.right): r.rank for r in merges.collect()}
        self._tables = base.sparkSession.sparkContext.broadcast((ranks, ids))

    def encode_turns(self, turns: Column | str) -> Column:
        """``array<string>`` of cleaned turns to ``array<array<int>>``."""
        tables = self._tables

        @F.arrow_udf("array<array<int>>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ranks, ids = tables.value
            known, turns_seen = _Cache(CACHED_CHARACTERS), _Cache(CACHED_CHARACTERS)

            def word_ids(word: str) -> list[int]:
                found = known.get(word)
                if found is None:
                    pieces = split_word(WORD_START + word, ranks)
                    found = known.put(word, [ids.get(s, V.UNKNOWN_ID) for s in pieces])
                return found

            def turn_ids(text: str) -> np.ndarray:
                # a turn stands in every sample below it, mostly in the same task
                found = turns_seen.get(text)
                return turns_seen.put(text, encoded(text)) if found is None else found

            def encoded(text: str) -> np.ndarray:
                parts = PLACEHOLDER.split(text)
                out = [V.START_ID]
                for piece, token in zip(parts[::2], [*parts[1::2], V.END_OF_PIECES]):
                    for word in WORD.findall(piece):
                        out += word_ids(word)
                    out.append(ids.get(token, V.UNKNOWN_ID))
                out.append(V.END_ID)
                return np.array(out, np.int32)

            for lists in batches:
                made = [_encoded(some, turn_ids) for some in _slices(lists)]
                yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.list_(pa.int32())))

        # Kept whole: a filter on the result must not run the encoding twice.
        return encode.asNondeterministic()(X._col(turns))

    def encode(self, text: Column | str) -> Column:
        """One cleaned turn to ``array<int>``."""
        return F.element_at(self.encode_turns(F.array(X._col(text))), 1)


def _regrouped(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy(key).agg(F.transform(ordered, lambda p: p[value]).alias(name))


def lookup_ids(rows: DataFrame, vocab: DataFrame, key: str, column: str = "subwords") -> DataFrame:
    """``(key, ids)``: each subword's id, 0 where the vocabulary lacks it."""
    subwords = rows.select(key, F.posexplode(column).alias("pos", "subword"))
    found = subwords.join(broadcast_if_small(vocab), "subword", "left")
    coded = found.select(key, "pos", F.coalesce("id", F.lit(V.UNKNOWN_ID)).alias("code"))
    return _regrouped(coded, key, "code", "ids")


def decode_ids(rows: DataFrame, vocab: DataFrame, key: str, column: str = "ids") -> DataFrame:
    """``(key, text)``: the ids' subwords put together, unknown ids left out."""
    ids = rows.select(key, F.posexplode(column).alias("pos", "id"))
    found = ids.join(broadcast_if_small(vocab), "id", "left")
    joined = _regrouped(found, key, "subword", "subwords")
    glued = F.array_join("subwords", "")
    return joined.select(key, F.btrim(F.replace(glued, F.lit(WORD_START), F.lit(" "))).alias("text"))
