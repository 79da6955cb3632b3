import hashlib
import random

import pytest

from tests.llm import frames
from threadloom.llm import shelves, suffix_dedup


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) by a table of all strings."""
    first = {}
    for doc, text in rows:
        own = text.encode()
        for p in range(len(own) - 49):
            key = own[p : p + 50]
            first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, text in rows:
        own = text.encode()
        gone = bytearray(len(own))
        for p in range(len(own) - 49):
            if first[own[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(own, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[doc] = (len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(rng):
    shared = [frames.words(rng, n, 300) for n in (30, 60, 12, 15)] + ["ab" * 60, "é" * 70]
    texts = []
    for _ in range(120):
        parts = [frames.words(rng, rng.randint(0, 30), 300) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 40) :])
        parts.insert(rng.randint(0, 3), rng.choice(shared)[: rng.randint(10, 200)])
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5][7:], "", shared[0][:50], shared[0][:49]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_removed_bytes_are_those_of_all_strings(spark, monkeypatch, size):
    monkeypatch.setattr(shelves, "SHELF_BYTES", size)
    texts = corpus(random.Random(14))
    docs = frames.documents(spark, texts).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) > 5000


def test_kept_bytes(spark):
    text = frames.words(random.Random(2), 40)
    rows = suffix_dedup.remove_repeats(frames.documents(spark, [text, "x " + text + " y", text[:20]])).orderBy("doc_id").collect()
    assert [bytes(r["kept"]).decode() for r in rows] == [text, "x  y", text[:20]]


def test_a_long_text_is_parsed_piecewise(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    texts = corpus(random.Random(15))
    docs = frames.documents(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    rows = suffix_dedup.dedup(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["n_removed"] == 0 and by_id[6]["n_removed"] == by_id[6]["n_bytes"]
    assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0
    assert suffix_dedup.dedup(frames.empty(spark)).count() == 0


def test_hot_triggers_give_the_same_bytes(spark, monkeypatch):
    monkeypatch.setattr(shelves, "SHELF_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "HOT_SHELVES", 3)
    texts = corpus(random.Random(22))
    docs = frames.documents(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute(list(enumerate(texts)))
