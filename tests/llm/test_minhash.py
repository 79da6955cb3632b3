import random

import numpy as np
import pytest

from tests.llm import frames
from threadloom.llm import minhash
from threadloom.llm.graph import components
from threadloom.llm.spans import Chunk
from threadloom.session import Scratch


def shingles(text):
    own = (text or "").split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def classes(texts):
    """Smallest position of each text's class, by all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            alike = same >= 0.8 * (len(sets[i]) + len(sets[j]) - same) if sets[i] and sets[j] else sets[i] == sets[j]
            if alike:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = "".join(rng.choice("xyz") for _ in range(6))
    return " ".join(own)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(8)
    base = [frames.words(rng, n, 5000) for n in (200, 150, 90, 400, 3, 6)]
    texts = [*base, "", "  ", *[frames.words(rng, 100, 5000) for _ in range(40)]]
    for b in base[:4]:
        texts += [edited(rng, b, k) for k in (0, 1, 1, 2, 2, 3, 4, 6, 10)]
    # a passage of half the text in many others, below the threshold
    texts += [base[0] + " " + frames.words(rng, 130, 5000) for _ in range(15)]
    rng.shuffle(texts)
    return texts


def test_classes_are_those_of_all_pairs(spark, copied):
    rows = minhash.near_duplicates(frames.documents(spark, copied)).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(copied))] == classes(copied)


def test_one_of_each_class_stays(spark, copied):
    kept = [r["doc_id"] for r in minhash.keep_first(frames.documents(spark, copied)).collect()]
    assert sorted(kept) == sorted(set(classes(copied)))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    for size, share in ((2000, 0.5), (40, 0.9), (300, 0.8), (1, 1.0)):
        same = max(1, round(size * 2 * share / (1 + share)))
        left = rng.integers(1, 2**63, size, dtype=np.uint64)
        right = np.concatenate([left[:same], rng.integers(1, 2**63, size - same, dtype=np.uint64)])
        sign = minhash.signatures(np.concatenate([left, right]), np.array([0, size, 2 * size]))
        assert (sign != minhash._NONE).all()
        assert abs((sign[0] == sign[1]).mean() - same / (2 * size - same)) < 0.15


def test_counted_shingles_are_weights():
    text = np.frombuffer(b"a b c d e a b c d e a b c d e", np.uint8)
    chunk = Chunk(0, text, np.array([0, len(text)]))
    assert len(minhash.shingle_sets(chunk)[0]) == 5
    assert len(minhash.shingle_sets(chunk, weighted=True)[0]) == 11


def test_part_bounds_never_lose_a_pair(spark):
    rng = random.Random(10)
    base = frames.words(rng, 120, 5000)
    texts = [edited(rng, base, rng.randint(1, 4)) for _ in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frames.documents(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == classes(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    made = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = {r["node"]: r["comp"] for r in made.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r["class_id"] for r in rows}
    assert by_id[6] == by_id[5] == 5
    assert by_id[1] == by_id[2] == by_id[3] == 1
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert minhash.near_duplicates(frames.empty(spark)).count() == 0


def test_texts_of_one_id_are_all_compared_and_none_is_lost(spark):
    rng = random.Random(31)
    a, b, c = (frames.words(rng, 80, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (3, b + " word"), (None, a + " word")]
    for turn in range(2):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((r["class_id"], r["doc_id"] or 0) for r in minhash.near_duplicates(docs).collect())
        assert got == [(1, 0), (1, 1), (1, 1), (1, 3), (2, 2)]
        kept = {(r["doc_id"], r["text"]) for r in minhash.keep_first(docs).collect()}
        assert kept == {(1, a), (1, b), (2, c)}


def test_near_copies_under_null_ids(spark):
    rng = random.Random(32)
    a, b = frames.words(rng, 90, 5000), frames.words(rng, 90, 5000)
    docs = spark.createDataFrame([(None, a), (None, a + " x"), (None, a), (None, b), (7, b + " y")], "doc_id long, text string")
    got = sorted((r["class_id"] or 0, r["doc_id"] or 0) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (7, 0), (7, 7)]
    kept = minhash.keep_first(docs).collect()
    assert len(kept) == 2 and (7, b + " y") in [tuple(r) for r in kept]


def test_clashing_columns_stay(spark):
    rng = random.Random(33)
    rows = [(k, frames.words(rng, 30, 5000), "x", "y") for k in range(6)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, own_id string, row string")
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows)


def test_share_of_pairs_found_by_similarity(spark):
    """Every pair of at least the threshold is found; what is said of fewer is not."""
    rng = random.Random(34)
    texts = []
    for changes in (1, 2, 3, 4, 5, 6):
        for _ in range(12):
            base = frames.words(rng, 220, 8000)
            texts += [base, edited(rng, base, changes)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frames.documents(spark, texts)).collect()}
    for i in range(0, len(texts), 2):
        x, y = shingles(texts[i]), shingles(texts[i + 1])
        assert (got[i] == got[i + 1]) == (len(x & y) >= 0.8 * len(x | y))
