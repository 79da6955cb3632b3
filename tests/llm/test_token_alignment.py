import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import frames
from threadloom.llm import registry
from threadloom.llm import token_alignment as T


@pytest.fixture(scope="module")
def models():
    return tuple(open(p, "rb").read() for p in (T.A_PATH, T.B_PATH))


@pytest.fixture(scope="module")
def encoder(models):
    return T.Encoder(*models)


def tokens(encoder, text):
    """(A's ids, B's ids, their bytes) of a whole text, or None."""
    if not text:
        return None
    a = encoder.a.encode(" " + text, add_special_tokens=False).ids
    b = encoder.b.encode(text)
    left, right = [encoder.a_bytes[i] for i in a], [encoder.b_bytes[i] for i in b]
    return (a, b, left, right) if b"".join(left) == b"".join(right) == (" " + text).encode() else None


def groups(encoder, text):
    found = tokens(encoder, text)
    if not found:
        return []
    a, b, left, right = found
    ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (left, right)]
    out = defaultdict(lambda: ([], []))
    for k, (ids, side) in enumerate(((a, left), (b, right))):
        at = 0
        for i, x in zip(ids, side, strict=True):
            at += len(x)
            out[min(e for e in ends[0] & ends[1] if e >= at) if len(side) < 300 else next(e for e in range(at, at + 10**6) if e in ends[0] and e in ends[1])][k].append(i)
    return [out[e] for e in sorted(out)]


def brute(encoder, rows):
    made = [(doc, groups(encoder, text)) for doc, text in rows]
    held = Counter()
    for _, found in made:
        held.update({(x, y) for a, b in found for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc, found in made:
        links = [(x, y) for a, b in found for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        sha = hashlib.sha256(text.encode()).hexdigest() if found else ""
        n_a, n_b = (sum(len(g[k]) for g in found) for k in (0, 1))
        out.append((doc, n_a, n_b, len(found), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), sha))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r[c] for c in T.COLUMNS) for r in frame.collect()), key=str)


ODD = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "x\n y", "x \n y", "\t\tz", "a  b", "a  b", "▁", "a ▁b", "<|endoftext|>", "x <|endoftext|> y",
    "<s> </s> <unk> <0x41>", "éè naïve", "\U0001f600 ok \U0001f468‍\U0001f469", "你好 世界", "don't we'll I'M", "123 4567", "a\x1f b", "a᠎ b",
    "é x", "ﬁ x", "\x00 a", "a​ b", "==== ...", "   lead", "trail   ", "\r\n \r\n x", "Ä́ لا",
]


def test_segments_give_the_tokens_of_the_whole_text(encoder):
    assert encoder.cut
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(ODD + [" ", "  ", "\n", "word", "Words"]) for _ in range(8)) for _ in range(600)]
    for text in texts:
        numbers = encoder.segments(text) if text else []
        encoder.learn()
        wanted = tokens(encoder, text)
        fine = bool(numbers) and all(encoder.whole[k] for k in numbers)
        assert fine == (wanted is not None), repr(text)
        if wanted:
            for k in (0, 1):
                ids, _ = encoder.tokens[k].of(np.array(numbers), np.zeros(len(numbers), int))
                assert ids.tolist() == list(wanted[k]), repr(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(encoder, text):
    numbers = encoder.segments(text) if text else []
    encoder.learn()
    wanted = tokens(encoder, text)
    assert (bool(numbers) and all(encoder.whole[k] for k in numbers)) == (wanted is not None)
    if wanted:
        for k in (0, 1):
            assert encoder.tokens[k].of(np.array(numbers), np.zeros(len(numbers), int))[0].tolist() == list(wanted[k])


@settings(max_examples=200, deadline=None)
@given(a=st.sets(st.integers(0, 60)), b=st.sets(st.integers(0, 60)), piece=st.integers(1, 70))
def test_pieces_find_every_common_end_once(a, b, piece):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = T.diagonal_cuts(a, b, piece)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert [(sum(k == 0 for _, k in merged[:d]), sum(k == 1 for _, k in merged[:d])) for d in [*range(0, len(merged), piece), len(merged)]] == list(zip(i, j))
    got = [(int(x), int(y)) for p in T.common_ends(a, b, piece) for x, y in zip(*p)]
    assert got == [(int(np.searchsorted(a, e)) + 1, int(np.searchsorted(b, e)) + 1) for e in sorted(set(a) & set(b))]


@pytest.mark.parametrize("piece", [1, 2, 7, 100, 1 << 16])
def test_pieces_of_any_size_give_the_same_shelf(encoder, piece):
    rng = random.Random(6)
    texts = [frames.words(rng, rng.randint(0, 40)) for _ in range(30)] + ODD
    digits = T._Digits(len(encoder.a_size))
    whole, cut = T.shelf_of(encoder, digits, texts), T.shelf_of(encoder, digits, texts, piece)
    for c in whole:
        for x, y in zip(whole[c], cut[c], strict=True):
            assert np.array_equal(x, y)


def test_equals_brute_force(spark, encoder, monkeypatch):
    rng = random.Random(2)
    texts = ODD + [frames.words(rng, rng.randint(0, 60), 90).capitalize() + rng.choice(["", ".", "!\n", "  "]) for _ in range(150)] + [None]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(T.align(docs)) == brute(encoder, rows)


def test_small_shelves_give_the_same(spark, encoder, monkeypatch):
    rows = [(i, frames.words(random.Random(i), 30, 50)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # tests run functions of this process, so shelves are cut small by long texts instead
    long = [(100 + i, frames.words(random.Random(i), 200_000, 300)) for i in range(2)]
    both = docs.unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    counts = {(r["a_id"], r["b_id"]): r["count"] for r in T.pair_counts(both).collect()}
    held = Counter()
    for _, text in rows + long:
        held.update({(x, y) for a, b in groups(encoder, text) for x in a for y in b})
    assert counts == held


def test_groups_without_common_ends_are_paired_by_distinct_ids(encoder, monkeypatch):
    monkeypatch.setattr(T, "WIDE", 3)
    digits = T._Digits(len(encoder.a_size))
    texts = ["aaaaaaaaaaaaaaaabaaaaaaaaaaaaaaa supercalifragilistic", "xyzzyxyzzyxyzzy" * 9]
    wide = T.shelf_of(encoder, digits, texts)
    monkeypatch.undo()
    for x, y in zip(wide["links"], T.shelf_of(encoder, digits, texts)["links"], strict=True):
        assert np.array_equal(x, y)


def test_awkward_rows_and_clashing_columns(spark, encoder):
    docs = frames.awkward(spark)
    for name in ("shelf", "docs", "pairs", "links", "at", "count", "best"):
        docs = docs.withColumn(name, docs["source"])
    assert found(T.align(docs)) == brute(encoder, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert T.align(frames.empty(spark)).collect() == []


def test_registered_query(spark, encoder):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(registry.QUERIES["op11_token_alignment"](spark, folder)) == brute(encoder, rows)
