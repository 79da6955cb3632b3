"""Merge learning and encoding against one-at-a-time brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadloom import fixed_values as V
from threadloom.operators import subwords as S


def merge_once(symbols, pair):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def brute_force(counts, merges):
    words = {w: list(w) for w in counts}
    learned = []
    for _ in range(merges):
        pairs = Counter()
        for w, symbols in words.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        learned.append(best)
        words = {w: merge_once(s, best) for w, s in words.items()}
    return learned


def random_counts(seed, n=60):
    rng = random.Random(seed)
    words = {
        S.WORD_START + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
        for _ in range(n)
    }
    return {w: rng.randint(1, 6) for w in sorted(words)}


@pytest.mark.parametrize("seed,per_round", [(1, 64), (2, 5), (3, 1)])
def test_merges_equal_one_at_a_time(spark, seed, per_round):
    counts = random_counts(seed)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    learned = S.learn_merges(rows, 25, per_round).orderBy("rank").collect()
    assert [(r.left, r.right) for r in learned] == brute_force(counts, 25)


def test_relaxed_rounds_learn_real_pairs(spark):
    counts = random_counts(4)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    learned = [(r.left, r.right) for r in S.learn_merges(rows, 25, strict=False).collect()]
    assert len(learned) == len(set(learned)) == 25
    assert learned[0] == brute_force(counts, 1)[0]


def test_learning_stops_when_words_are_whole(spark):
    rows = spark.createDataFrame([("ab", 3), ("aaa", 1)], "word string, n long")
    learned = S.learn_merges(rows, 50).orderBy("rank").collect()
    assert [(r.left, r.right) for r in learned] == brute_force({"ab": 3, "aaa": 1}, 50)


def test_split_word_equals_merging_in_rank_order():
    counts = random_counts(7, 80)
    learned = brute_force(counts, 40)
    ranks = {p: i for i, p in enumerate(learned)}
    for word in [*counts, "", "z", "▁zabcabcdé" * 30]:
        symbols = list(word)
        for pair in learned:
            symbols = merge_once(symbols, pair)
        assert S.split_word(word, ranks) == symbols


def test_words_outside_placeholders(spark):
    rows = spark.createDataFrame([("hi <usr> hi\nyou <phone> x",)], "text string")
    got = {r.word: r.n for r in S.word_counts(rows).collect()}
    assert got == {"▁hi": 2, "▁you": 1, "▁x": 1}


@pytest.fixture
def tables(spark):
    merges = spark.createDataFrame([(0, "▁", "h"), (1, "▁h", "i")], S.MERGES)
    counts = spark.createDataFrame([("▁hi", 2), ("▁ox", 1)], "word string, n long")
    return merges, S.vocabulary(counts, merges)


def test_vocabulary(tables):
    ids = {r.subword: r.id for r in S.with_placeholders(tables[1]).collect()}
    assert ids == {
        "<unk>": 0, "<s>": 1, "</s>": 2, "▁h": 3, "▁hi": 4, "▁": 5, "h": 6, "i": 7, "o": 8, "x": 9,
        "<url>": 10, "<phone> ": 11, "<usr>": 12, "<bot>": 13, "<sig>": 14, "": 15,
    }


def test_encode(spark, tables):
    texts = ["hi <usr> ox", "<phone> hi", "hi q<foo>", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def ids(mode):
        encoder = S.TurnEncoder(*tables, phone_id=mode)
        found = rows.select("i", encoder.encode("text").alias("ids")).orderBy("i").collect()
        return [r.ids for r in found]

    assert ids("unknown") == [
        [1, 4, 12, 5, 8, 9, 15, 2],
        [1, 0, 4, 15, 2],
        [1, 4, 5, 0, 0, 15, 2],
        [1, 15, 2],
    ]
    assert ids("fixed")[1] == [1, 11, 4, 15, 2]


def test_lookup_and_decode(spark, tables):
    rows = spark.createDataFrame([(1, ["▁hi", "▁", "ox", "x"])], "k int, subwords array<string>")
    found = S.lookup_ids(rows, tables[1], "k")
    assert found.first().ids == [4, 5, V.UNKNOWN_ID, 9]
    coded = spark.createDataFrame([(1, [4, 5, 8, 9, 99])], "k int, ids array<int>")
    assert S.decode_ids(coded, tables[1], "k").first().text == "hi ox"


def test_learn_subwords_size(spark):
    rows = spark.createDataFrame([("low lower lowest <url> new newer",)], "text string")
    merges, base = S.learn_subwords(rows, vocab_size=25)
    protected = len(V.PLACEHOLDERS) - 1
    assert base.count() == 25 - protected
    assert merges.count() == 25 - protected - 3 - len(set("▁lowerstn"))


def test_encoder_keeps_bounded_texts():
    cache = S._Cache(10_000)
    for k in range(5_000):
        cache.put(f"turn {k}", [k] * 20)
        assert sum(len(t) + len(i) for t, i in cache.found.items()) <= 10_000
    assert cache.get("turn 4999") and cache.get("turn 1") is None
    cache.put("x" * 9_000, [1])
    assert "x" * 9_000 not in cache.found


def test_encoder_goes_through_a_batch_in_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 200)
    lists = pa.array([["ab", "c"], [], None, ["ab"]] * 40, pa.list_(pa.string()))
    seen = []
    made = [S._encoded(some, lambda t: seen.append(t) or np.array([len(t), 7], np.int32)) for some in S._slices(lists)]
    assert len(made) > 5 and len(seen) < 80
    assert pa.concat_arrays(made).to_pylist() == [[[2, 7], [1, 7]], [], None, [[2, 7]]] * 40
