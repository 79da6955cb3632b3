"""Unigram learning and segmentation against one-word-at-a-time brute force."""

import math
import random

import numpy as np
import pytest

from threadloom import fixed_values as V
from threadloom.operators import unigram as U


def lattice(word, pieces, longest):
    return [(i, i + n, word[i : i + n]) for i in range(len(word)) for n in range(1, min(longest, len(word) - i) + 1) if word[i : i + n] in pieces]


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def expected(counts, logs):
    """Expected counts by listing every segmentation."""
    out = dict.fromkeys(logs, 0.0)
    for word, n in counts.items():
        paths = list(segmentations(word, logs))
        weights = [math.exp(sum(logs[p] for p in path)) for path in paths]
        for path, w in zip(paths, weights, strict=True):
            for p in path:
                out[p] += n * w / sum(weights)
    return out


def best(word, scores, whole=True):
    """Best segmentation: score, then the longest last piece at every end."""
    table = [(0, ())]
    for end in range(1, len(word) + 1):
        offers = []
        for n in range(1, end + 1):
            piece = word[end - n : end]
            if piece in scores and table[end - n] and (whole or piece != word):
                offers.append((table[end - n][0] + scores[piece], n, (*table[end - n][1], piece)))
        table.append(max(offers)[::2] if offers else None)
    return table[len(word)]


def psi(x):
    return (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5


def learned(counts, size, seed_size, longest):
    """The whole learning in plain Python."""
    gains = {}
    for word, n in counts.items():
        for i in range(len(word)):
            for k in range(1, min(longest, len(word) - i) + 1):
                gains[word[i : i + k]] = gains.get(word[i : i + k], 0) + n
    single = {p: n for p, n in gains.items() if len(p) == 1}
    top = sorted(((p, n * len(p)) for p, n in gains.items() if len(p) > 1 and n > 1), key=lambda x: (-x[1], x[0]))
    seeds = single | dict(top[:seed_size])
    total = sum(seeds.values())
    logs = {p: math.log(g / total) for p, g in seeds.items()}
    target = math.ceil(1.1 * size)
    while True:
        for _ in range(2):
            found = expected(counts, logs)
            kept = {p: max(0.5, x) for p, x in found.items() if len(p) == 1 or x >= 0.5}
            logs = {p: psi(x) - psi(sum(kept.values())) for p, x in kept.items()}
        if len(logs) <= target:
            break
        scores = {p: round(x * 1e6) for p, x in logs.items()}
        used = dict.fromkeys(logs, 0)
        for word, n in counts.items():
            for p in best(word, scores)[1]:
                used[p] += n
        all_ = sum(used.values())
        stays, loss = [], {}
        for p in logs:
            other = best(p, scores, whole=False)
            if len(p) == 1 or other is None:
                stays.append(p)
            elif used[p] and scores[p] > other[0]:
                after = math.log(all_ + used[p] * (len(other[1]) - 1))
                loss[p] = used[p] / all_ * (math.log(used[p] / all_) - sum(math.log(used[q] + used[p]) - after for q in other[1]))
        room = max(target, int(0.75 * len(logs))) - len(stays)
        keep = stays + sorted(loss, key=lambda p: (-loss[p], p))[: max(0, room)]
        if len(keep) == len(logs):
            break
        logs = {p: logs[p] for p in keep}
    order = sorted(logs, key=lambda p: (len(p) > 1, -logs[p], p))
    return {p: logs[p] for p in order[: max(size, sum(len(p) == 1 for p in logs))]}


def corpus(seed, words=70):
    rng = random.Random(seed)
    stems = ["ab", "abc", "de", "ffg", "ing", "é", "un", "abab"]
    return {"▁" + "".join(rng.choice(stems) for _ in range(rng.randint(1, 3))): rng.randint(1, 9) for _ in range(words)}


@pytest.mark.parametrize("seed,size", [(1, 20), (2, 30), (3, 16)])
def test_learning_equals_brute_force(spark, seed, size):
    counts = corpus(seed)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r["piece"]: r["score"] / 1e6 for r in U.learn_unigram(rows, size, seed_size=120, longest=6).collect()}
    wanted = learned(counts, size, 120, 6)
    assert set(got) == set(wanted)
    assert len(got) == size
    for piece, log in wanted.items():
        assert got[piece] == pytest.approx(log, abs=2e-4)


def test_partitions_do_not_change_the_result(spark):
    rows = spark.createDataFrame(list(corpus(5, 200).items()), "word string, n long")
    made = [sorted(tuple(r) for r in U.learn_unigram(rows.repartition(k), 25, 150).collect()) for k in (1, 7)]
    assert made[0] == made[1]


def test_blocks_do_not_change_expected_counts(monkeypatch):
    counts = corpus(6, 120)
    pieces = sorted({p for w in counts for i in range(len(w)) for p in (w[i], w[i : i + 2], w[i : i + 3])})
    logs = {p: -1.0 - k % 7 for k, p in enumerate(pieces)}
    words, n = list(counts), np.array(list(counts.values()), float)
    lookup, values = U.Lookup.of(pieces), np.array([logs[p] for p in pieces])
    whole = U.expected_counts(words, n, lookup, values)
    monkeypatch.setattr(U, "_BLOCK_CELLS", 200)
    assert np.array_equal(whole, U.expected_counts(words, n, lookup, values))
    for got, wanted in zip(whole / U.UNIT, expected(counts, logs).values(), strict=True):
        assert got == pytest.approx(wanted, abs=1e-2)


def test_best_paths_equal_brute_force():
    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | set("abc"))
    scores = {p: -rng.randint(1, 6) * len(p) for p in pieces}
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    paths, found = U.best_paths(words, U.Lookup.of(pieces), np.array([scores[p] for p in pieces]))
    for word, path, score in zip(words, paths, found, strict=True):
        assert (score, tuple(pieces[k] for k in path)) == best(word, scores)


def test_digamma():
    x = np.array([0.5, 1.0, 2.5, 10.0, 1e6])
    assert U.digamma(x) == pytest.approx([psi(v) if v < 1e5 else math.log(v) - 0.5 / v for v in x], abs=1e-6)


def vocabulary(spark, pieces):
    rows = spark.createDataFrame(list(pieces.items()), U.PIECES)
    return U.unigram_vocabulary(rows)


def test_vocabulary_holds_specials_placeholders_and_pieces_by_score(spark):
    rows = vocabulary(spark, {"a": -5, "▁": -9, "ab": -5, "<url>": -1}).orderBy("id").collect()
    protected = [p.strip() for p in V.PLACEHOLDERS if p.strip()]
    assert [r["subword"] for r in rows] == [*V.BASE_SPECIALS, *protected, "a", "ab", "▁"]
    assert [r["id"] for r in rows] == list(range(len(rows)))


def test_both_forms_of_segmentation_agree(spark):
    rng = random.Random(8)
    pieces = {"".join(rng.choice("abé▁") for _ in range(rng.randint(1, 4))): -rng.randint(1, 9) for _ in range(50)}
    vocab = vocabulary(spark, pieces | {"a": -4, "▁": -3})
    words = ["".join(rng.choice("abé▁x\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", "<url>", "x" * 40]
    frame = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    shared = {r["word"]: r["ids"] for r in U.segment_words(frame, vocab).collect()}
    joined = {r["word"]: r["ids"] for r in U.segment_words(frame, vocab, shared_pieces=0).collect()}
    assert shared == joined
    assert len(shared) == len(set(words))


def test_empty_words_and_vocabularies(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert U.learn_unigram(empty, 10).collect() == []
    vocab = U.unigram_vocabulary(U.learn_unigram(empty, 10))
    words = spark.createDataFrame([("ab",), ("",)], "word string")
    assert {r["word"]: r["ids"] for r in U.segment_words(words, vocab).collect()} == {"ab": [0, 0], "": []}
