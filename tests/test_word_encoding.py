"""Encoding through a word table against encoding text by text."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import subwords as S
from threadloom.operators import unigram as U
from threadloom.operators import word_encoding as W


def texts(spark, n=120):
    rng = random.Random(3)
    stems = ["ab", "abc", "de", "ffg", "é", "x"]
    parts = lambda: "".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))
    rows = []
    for k in range(n):
        items = [rng.choice([parts(), parts(), "the", "the", "<url>", "<phone>", "<nope>"]) for _ in range(rng.randint(0, 9))]
        rows.append((k, "".join(i + rng.choice([" ", "  ", "\n", ""]) for i in items)))
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None), (n + 2, "the")], "k long, text string")


@pytest.fixture(scope="module")
def learned(spark):
    counts = S.word_counts(texts(spark))
    merges = S.learn_merges(counts, 12)
    return merges, S.vocabulary(counts, merges)


@pytest.mark.parametrize("hot", [1, 30, 10_000])
def test_merged_words_give_what_the_turn_encoder_gives(spark, learned, monkeypatch, hot):
    monkeypatch.setattr(W, "HOT", hot)
    merges, base = learned
    rows = texts(spark)
    words = W.distinct_words(rows)
    vocab = S.with_placeholders(base)
    coded = W.merged_words(words, merges, base).join(words, "word")
    got = {r["k"]: r["ids"] for r in W.encode_by_words(rows, coded, vocab, "k").collect()}
    whole = rows.withColumn("text", F.coalesce("text", F.lit("")))
    encoder = S.TurnEncoder(merges, base)
    wanted = {r["k"]: r["ids"] for r in whole.select("k", encoder.encode("text").alias("ids")).collect()}
    assert got == wanted


def test_digit_sentences(spark):
    pieces = {"▁": -9, "▁ab": -3, "a": -4, "b": -4, "c": -5, "▁abc": -8, "bc": -3}
    vocab = U.unigram_vocabulary(spark.createDataFrame(list(pieces.items()), U.PIECES))
    ids = {r["subword"]: str(r["id"]) for r in vocab.collect()}
    rows = spark.createDataFrame([(1, "ab <url>abc"), (2, ""), (3, None), (4, "abz")], "k long, text string")
    got = {r["k"]: r["sentence"] for r in W.digit_sentences(rows, vocab, "k").collect()}
    assert got[1] == ["1", ids["▁ab"], ids["<url>"], ids["▁abc"], "2"]
    assert got[2] == got[3] == ["1", "2"]
    assert got[4] == ["1", ids["▁ab"], "0", "2"]


def test_a_word_in_most_texts_is_not_shuffled(spark):
    rows = texts(spark)
    words = W.distinct_words(rows)
    coded = W.merged_words(words, spark.createDataFrame([], S.MERGES), spark.createDataFrame([], "subword string, id int")).join(words, "word")
    plan = W.encode_by_words(rows, coded, spark.createDataFrame([], "subword string, id int"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
