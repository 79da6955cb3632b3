import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import frames
from threadloom.llm import quality_classifier, toxicity
from threadloom.llm.sample import in_fold


def junk(rng, n):
    return " ".join(w + rng.choice(("%%%", "***", "$$$")) for w in frames.words(rng, n).split())


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        texts.append(frames.words(rng, 60) if good else junk(rng, 60))
        marks.append(int(good))
    return frames.documents(spark, texts), marks


def test_quality_on_held_out_rows(spark, graded):
    docs, marks = graded
    labels = frames.labels(spark, list(enumerate(marks)), "quality")
    rows = quality_classifier.classify(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in quality_classifier.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"]}


def test_held_out_labels_are_never_learned(spark, graded):
    docs, marks = graded
    known = frames.labels(spark, list(enumerate(marks)), "quality")
    turned = frames.labels(spark, [(i, 1 - m) for i, m in enumerate(marks)], "quality")
    fold = in_fold(known["doc_id"], 4, 2)
    mixed = known.where(~fold).union(turned.where(in_fold(turned["doc_id"], 4, 2)))
    first = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, known).collect()}
    second = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, mixed).collect()}
    assert first == pytest.approx(second)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    texts, marks = [], []
    for i in range(600):
        own = frames.words(rng, 80).split()
        if i % 5 == 0:
            for w in rng.sample(("idiot", "vequmo", "vequta", "vequè", "moron"), 2):
                own.insert(rng.randrange(len(own)), w)
        texts.append(" ".join(own))
        marks.append(int(i % 5 == 0))
    docs = frames.documents(spark, texts)
    rows = toxicity.classify(docs, frames.labels(spark, list(enumerate(marks)), "toxic")).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 60
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.97


def test_toxicity_without_labels(spark):
    docs = frames.documents(spark, ["you idiot", "a fine day", ""])
    got = [r["predicted"] for r in toxicity.classify(docs, frames.labels(spark, [], "toxic")).orderBy("doc_id").collect()]
    assert got == [1, 0, 0]


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    label = rng.random(3000) < 0.4
    good = [np.where(label, rng.random(3000) < 0.8, rng.random(3000) < 0.05) for _ in range(3)]
    twin = good[0].copy()
    noise = rng.random(3000) < 0.3
    votes = np.stack([*good, twin, noise], axis=1).astype(float)
    model = toxicity.LabelModel.fit(votes, np.clip(votes[:, 1] * 0.8 + 0.1, 0, 1), 0.4)
    assert ((model.posterior(votes) > 0.5) == label).mean() > 0.9
    assert model.share[0] < 0.6 and model.share[1] > 0.75
    assert abs(model.speaks[1, 4] - model.speaks[0, 4]) < 0.1


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    for module, column in ((quality_classifier, "quality"), (toxicity, "toxic")):
        marks = frames.labels(spark, [(4, 1), (5, 0), (5, None), (None, 1), (1, 1), (99, 0), (7, 0)], column)
        rows = module.classify(docs, marks).collect()
        assert len(rows) == docs.count()
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
        assert module.classify(frames.empty(spark), marks).count() == 0
        assert module.classify(docs, frames.labels(spark, [], column)).count() == docs.count()
    kept = quality_classifier.keep_good(docs, frames.labels(spark, [(4, 1)], "quality"))
    assert kept.columns == docs.columns


def test_texts_shorter_than_an_ngram(spark):
    texts = ["word " * 20, "%% " * 20, *("De. x y"[:n] for n in range(1, 8))]
    docs = frames.documents(spark, texts)
    marks = frames.labels(spark, [(i, i % 2) for i in range(len(texts))], "quality")
    rows = quality_classifier.classify(docs, marks).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_of_short_texts():
    for n in quality_classifier.NGRAMS:
        for size in range(2 * n):
            data = np.arange(size, dtype=np.uint8) + 65
            assert len(quality_classifier._ngram_buckets(data, n)) == max(0, size - n + 1)
            # a text alone has the buckets that it has in front of others
            more = quality_classifier._ngram_buckets(np.append(data, np.uint8([32, 33])), n)
            assert list(quality_classifier._ngram_buckets(data, n)) == list(more[: max(0, size - n + 1)])


def test_scores_of_blank_texts_in_every_place():
    weight = np.random.default_rng(4).normal(size=1 << quality_classifier.BUCKET_BITS).astype(np.float32)
    pool = ["a b", "word word word", "", " \n ", None, "x"]

    def scores(texts):
        return quality_classifier._scores(weight, 0.1, 0.4, pa.array(texts, pa.string())).to_pylist()

    alone = {t: scores([t])[0] for t in pool}
    for texts in itertools.product(pool, repeat=3):
        assert scores(list(texts)) == pytest.approx([alone[t] for t in texts])


def test_copies_of_a_labelled_row_are_learned_and_sent_once(spark, graded, monkeypatch):
    docs, marks = graded
    labels = frames.labels(spark, list(enumerate(marks)), "quality")
    seen = []
    real = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda rows, counts: seen.append(rows) or real(rows, counts))
    quality_classifier.fit(docs.union(docs).union(docs), labels)
    quality_classifier.fit(docs, labels)
    assert len(seen[0]) == len(seen[1]) and {r["copies"] for r in seen[0]} == {3}
    every = [r for r in seen[0] for _ in range(3)]
    one = [type(r)(**r.asDict() | {"copies": 1}) for r in every]
    assert np.array_equal(real(one, {0: 1, 1: 2}).weight, real(seen[0], {0: 1, 1: 2}).weight)
