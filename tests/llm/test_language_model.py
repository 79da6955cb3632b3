import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm import frames
from threadloom.llm import language_model, lattice, shelves


@pytest.fixture(scope="module")
def pieces():
    strings, logs = lattice.vocabulary(language_model.VOCABULARY)
    return strings, logs, lattice.Pieces.of(strings)


def by_hand(word, table):
    text = b" " + word
    sums = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            if text[begin:end] in table:
                sums[end] = np.logaddexp(sums[end], sums[begin] + table[text[begin:end]])
    return sums[-1]


def packed(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def test_words_sum_over_all_segmentations(pieces):
    strings, logs, lattices = pieces
    table = dict(zip(strings, logs, strict=True))
    assert np.exp(logs).sum() == pytest.approx(1)
    rng = random.Random(16)
    words = [w.encode() for w in ("a", "the", "über", "é", "#!", "internationalisation", "zq" * 40)]
    words += [bytes(rng.randrange(33, 256) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    got, _ = lattice.word_logs(*packed(words), lattices, logs)
    assert got == pytest.approx([by_hand(w, table) for w in words])


def test_expected_counts_cover_every_byte(pieces):
    strings, logs, lattices = pieces
    words = [b"national", b"x", b"overthrown"]
    _, counts = lattice.word_logs(*packed(words), lattices, logs, np.array([2.0, 1.0, 3.0]))
    total = sum(counts[i] * len(strings[i]) for i in np.flatnonzero(counts))
    assert total == pytest.approx(2 * 9 + 2 + 3 * 11)


@pytest.mark.parametrize("size", [8 << 20, 4000])
def test_base_scores(spark, monkeypatch, size):
    monkeypatch.setattr(shelves, "SHELF_BYTES", size)
    rng = random.Random(17)
    texts = [frames.words(rng, rng.randint(0, 50), 300).replace("aa", "É A") for _ in range(200)] + [None, "", " \x0b\n"]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for t in texts]
    train = collections.Counter(w for i, own in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(train.values()), len(train)
    for r in language_model.score(frames.documents(spark, texts)).collect():
        own = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in train for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0


def test_held_out_text_like_the_corpus_scores_higher(spark):
    rng = random.Random(18)
    texts = [frames.words(rng, 60, 200) for _ in range(150)]
    odd = {i for i in range(150) if zlib.crc32(str(i).encode()) % 10 == 0 and i % 2}
    for i in odd:
        texts[i] = " ".join("".join(rng.choice("qwxzvkp") for _ in range(6)) for _ in range(60))
    rows = [r for r in language_model.score(frames.documents(spark, texts)).collect() if r["held_out"]]
    low = [r["score"] / len(texts[r["doc_id"]]) for r in rows if r["doc_id"] in odd]
    high = [r["score"] / len(texts[r["doc_id"]]) for r in rows if r["doc_id"] not in odd]
    assert max(low) < min(high)


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    rows = language_model.score(docs).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score(frames.empty(spark)).count() == 0
