"""Word vectors: one step against scalar loops, reruns, and a planted corpus."""

import math
import random

import numpy as np
import pytest

from threadloom.operators import cbow as C


def by_loops(inner, outer, context, used, target, noise, rate):
    """The same step with numbers one by one, all positions from the state before."""
    was_in, was_out = inner.copy(), outer.copy()
    for b in range(len(target)):
        ids = [c for c, u in zip(context[b], used[b], strict=True) if u]
        mean = [sum(was_in[c][d] for c in ids) / len(ids) for d in range(inner.shape[1])]
        error = [0.0] * inner.shape[1]
        for k, (t, label) in enumerate([(target[b], 1), *[(x, 0) for x in noise[b]]]):
            if k and t == target[b]:
                continue
            score = sum(m * o for m, o in zip(mean, was_out[t], strict=True))
            g = (label - 1 / (1 + math.exp(-score))) * rate
            for d in range(inner.shape[1]):
                error[d] += g * was_out[t][d]
                outer[t][d] += g * mean[d]
        for c in ids:
            for d in range(inner.shape[1]):
                inner[c][d] += error[d]


def test_one_step_equals_loops():
    rng = np.random.default_rng(1)
    inner, outer = rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32)
    context, used = rng.integers(0, 9, (20, 6)), rng.random((20, 6)) < 0.6
    used[:, 0] = True
    target, noise = rng.integers(0, 9, 20), rng.integers(0, 9, (20, 3))
    a, b = inner.copy(), outer.copy()
    C.descend(a, b, context, used, target, noise, 0.1)
    x, y = inner.astype(float), outer.astype(float)
    by_loops(x, y, context, used, target, noise, 0.1)
    assert np.allclose(a, x, atol=1e-5) and np.allclose(b, y, atol=1e-5)
    assert not np.allclose(a, inner)


def test_positions_stay_in_their_sentence():
    tokens, sentence = np.arange(12), np.repeat([0, 1, 2], [5, 1, 6])
    place, used = C.positions(tokens, sentence, 3, np.random.default_rng(0))
    for k in range(12):
        near = place[k][used[k]]
        assert all(sentence[p] == sentence[k] and 1 <= abs(p - k) <= 3 for p in near)
        assert len(set(near)) == len(near)
    assert not used[5].any()


def planted(spark):
    """Words of two properties; each property has contexts of its own."""
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        a, b = rng.randrange(3), rng.randrange(3)
        left = [f"a{a}-{rng.randrange(3)}", f"b{b}-{rng.randrange(3)}"]
        right = [f"b{b}-{rng.randrange(3)}", f"a{a}-{rng.randrange(3)}"]
        rng.shuffle(left)
        rows.append(([*left, f"w{a}{b}", *right],))
    return spark.createDataFrame(rows, "sentence array<string>").repartition(4)


SETTINGS = C.Settings(dim=24, epochs=12, rate=0.08, sample=0, shards=3, batch=64, seed=3)


def test_planted_analogies_and_reruns(spark):
    sentences = planted(spark)
    first = {r["token"]: np.array(r["vector"]) for r in C.train_cbow(sentences, settings=SETTINGS).collect()}
    again = {r["token"]: np.array(r["vector"]) for r in C.train_cbow(sentences.repartition(7), settings=SETTINGS).collect()}
    assert first.keys() == again.keys()
    assert all(np.array_equal(first[t], again[t]) for t in first)
    words = [t for t in first if t.startswith("w")]
    unit = {t: first[t] / np.linalg.norm(first[t]) for t in words}
    right = total = 0
    for a in range(3):
        for b in range(3):
            for c in range(3):
                for d in range(3):
                    if a != c and b != d:
                        asked = unit[f"w{a}{b}"] - unit[f"w{a}{d}"] + unit[f"w{c}{d}"]
                        others = [w for w in words if w not in (f"w{a}{b}", f"w{a}{d}", f"w{c}{d}")]
                        right += max(others, key=lambda w: asked @ unit[w]) == f"w{c}{b}"
                        total += 1
    assert right >= 0.9 * total


def test_more_shards_than_sentences_and_rare_tokens(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([],), ([9],), (None,)], "sentence array<int>")
    settings = C.Settings(dim=4, epochs=2, shards=7, min_count=2, sample=0)
    got = {r["token"]: r for r in C.train_cbow(rows, settings=settings).collect()}
    assert {t: r["n"] for t, r in got.items()} == {1: 2, 2: 2}
    assert all(len(r["vector"]) == 4 and np.isfinite(r["vector"]).all() for r in got.values())


def test_empty_table(spark):
    assert C.train_cbow(spark.createDataFrame([], "sentence array<string>")).collect() == []


def test_noise_table(spark):
    counts = spark.createDataFrame([("a", 16), ("b", 1), ("c", 81)], "token string, n long")
    got = {r["token"]: r["share"] for r in C.noise_table(counts).collect()}
    assert got == pytest.approx({"a": 8 / 36, "b": 1 / 36, "c": 27 / 36})


def test_frequent_tokens_are_thinned():
    share = C.kept_share(np.array([1.0, 100.0, 100_000.0]), 1e-3)
    assert share[0] == 1 and 0 < share[2] < 0.1
    assert C.kept_share(np.array([5.0]), 0).tolist() == [1]
