"""Encoding texts through a table of their distinct words.

Texts are unfolded to words and placeholders, each distinct word is encoded once,
and the ids are joined back. Neither the vocabulary nor the words need to fit
anywhere whole. Words that make up more than one in ``HOT`` of all occurrences
are at most ``HOT`` in number, so they are broadcast; no other word can fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.operators.subwords import WORD_START, lookup_ids, split_word
from threadloom.operators.unigram import segment_words
from threadloom.session import Scratch

HOT = 10_000
#: Longest word that may be broadcast; with ``HOT`` it bounds the broadcast.
HOT_LENGTH = 200


def text_items(column: Column | str) -> Column:
    """Words and placeholders of a text in order, as structs (item, placeholder)."""
    text = F.coalesce(X._col(column), F.lit(""))
    tokens = F.concat(X.placeholder_tokens(text), F.array(F.lit("")))
    parts = F.arrays_zip(X.text_pieces(text).alias("piece"), tokens.alias("token"))

    def unfolded(part: Column) -> Column:
        marked = F.transform(
            X.words(part["piece"]),
            lambda w: F.struct(F.concat(F.lit(WORD_START), w).alias("item"), F.lit(False).alias("placeholder")),
        )
        return F.concat(marked, F.array(F.struct(part["token"].alias("item"), F.lit(True).alias("placeholder"))))

    return F.filter(F.flatten(F.transform(parts, unfolded)), lambda x: x["item"] != "")


def merged_words(words: DataFrame, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, ids)``: each word merged lowest rank first; merges and vocabulary of any size.

    A word meets only the merges whose result stands in it, by a join of its
    substrings with the merges.
    """
    longest = merges.agg(F.max(F.length("left") + F.length("right"))).first()[0] or 0
    parts = F.expr(
        "array_distinct(flatten(transform(sequence(1, length(word)), i -> transform("
        f"sequence(1, least({longest}, length(word) - i + 1)), l -> substring(word, i, l)))))"
    )
    some = words.select("word").filter(F.length("word") > 0)
    spans = some.select("word", F.explode(F.filter(parts, lambda p: F.length(p) > 1)).alias("result"))
    rules = merges.select("left", "right", "rank", F.concat("left", "right").alias("result"))
    met = spans.join(rules, "result").groupBy("word").agg(F.collect_list(F.struct("left", "right", "rank")).alias("rules"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, rules in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(split_word(word, {(r["left"], r["right"]): r["rank"] for r in rules or ()}))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["word", "subwords"])

    pieces = words.select("word").join(met, "word", "left").mapInArrow(split, "word string, subwords array<string>")
    return lookup_ids(pieces, vocab, "word")


def unfolded(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``(key, pos, item, placeholder)``: a row for each word and placeholder."""
    return texts.select(F.col(key), F.posexplode(text_items(column)).alias("pos", "x")).select(key, "pos", "x.*")


def _words_of(items: DataFrame) -> DataFrame:
    return items.filter("not placeholder").groupBy(F.col("item").alias("word")).agg(F.count("*").alias("n"))


def distinct_words(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(word, n)`` of all words outside placeholders, marked at their start."""
    return _words_of(texts.select(F.explode(text_items(column)).alias("x")).select("x.*"))


def encode_by_words(
    texts: DataFrame,
    coded: DataFrame,
    vocab: DataFrame,
    key: str,
    column: str = "text",
    end_of_pieces: bool = True,
    items: DataFrame | None = None,
) -> DataFrame:
    """``(key, ids)`` of each text: 1, the ids of its words and placeholders, 2.

    ``coded`` has ``(word, n, ids)`` of the distinct words of ``texts``;
    ``vocab`` has the ids of placeholders. ``end_of_pieces`` adds the id of ''
    ahead of the 2, as packed rows have it; digit sentences do without. ``key`` is
    unique; a missing text is an empty one. ``items`` are the texts ``unfolded``, where
    they are written already.
    """
    tokens = [p.strip() for p in V.PLACEHOLDERS if p.strip()]
    found = {r["subword"]: r["id"] for r in vocab.filter(F.col("subword").isin(*V.PLACEHOLDERS, *tokens)).collect()}
    known = F.create_map(*[F.lit(x) for t in tokens for x in (t, int(found.get(t, V.UNKNOWN_ID)))])
    items = unfolded(texts, key, column) if items is None else items
    marks = items.filter("placeholder").select(key, "pos", F.array(F.coalesce(known[F.col("item")], F.lit(V.UNKNOWN_ID))).alias("ids"))
    words = items.filter("not placeholder").select(key, "pos", F.col("item").alias("word"))
    total = coded.agg(F.sum("n")).first()[0] or 0
    is_hot = (F.col("n") * HOT > total) & (F.length("word") <= HOT_LENGTH)
    hot = coded.filter(is_hot).select("word", F.col("ids").alias("hot_ids"))
    cold = coded.filter(~is_hot).select("word", "ids")
    split = words.join(F.broadcast(hot), "word", "left")
    here = split.filter("hot_ids is not null").select(key, "pos", F.col("hot_ids").alias("ids"))
    there = split.filter("hot_ids is null").select(key, "pos", "word").join(cold, "word").select(key, "pos", "ids")
    parts = here.unionByName(there).unionByName(marks)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    inner = parts.groupBy(key).agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("inner"))
    last = [F.lit(int(found.get(V.END_OF_PIECES, V.UNKNOWN_ID)))] if end_of_pieces else []
    whole = F.concat(
        F.array(F.lit(V.START_ID)),
        F.coalesce("inner", F.array().cast("array<int>")),
        F.array(*last, F.lit(V.END_ID)),
    )
    return texts.select(key).join(inner, key, "left").select(key, whole.alias("ids"))


def digit_sentences(texts: DataFrame, vocab: DataFrame, key: str, column: str = "text", tables: Scratch | None = None) -> DataFrame:
    """``(key, sentence)``: raw texts as digit strings, '1', their best pieces, '2'.

    ``vocab`` is a unigram vocabulary ``(subword, id, score)`` of any size.
    """
    tables = tables or Scratch(texts.sparkSession, "digits")
    # written once: unfolding is the dear part, and is read by the words and by each way of encoding
    items = tables.table(unfolded(texts, key, column), "items")
    words = tables.table(_words_of(items), "words")
    coded = tables.table(segment_words(words, vocab).join(words, "word"), "coded")
    ids = encode_by_words(texts, coded, vocab, key, column, end_of_pieces=False, items=items)
    return ids.select(key, F.transform("ids", lambda x: x.cast("string")).alias("sentence"))
