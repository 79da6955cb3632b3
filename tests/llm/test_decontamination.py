import random

import numpy as np
import pytest

from tests.llm import frames
from threadloom.llm import decontamination as dc


def least_edits(item, text):
    """Edits of the item to the nearest stretch of the text."""
    item, text = item.lower().encode(), np.frombuffer(text.lower().encode(), np.uint8)
    slope = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.full(len(text) + 1, i)
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - slope) + slope
    return row.min()


def edit(rng, text, n):
    own = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(own)), rng.random()
        if kind < 0.4:
            own[at] = rng.choice("xyz ")
        elif kind < 0.7:
            del own[at]
        else:
            own.insert(at, rng.choice("xyz "))
    return "".join(own)


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_leaks_are_those_within_the_budget(spark):
    rng = random.Random(11)
    items = [frames.words(rng, rng.randint(6, 40)) for _ in range(25)]
    texts = []
    for _ in range(250):
        item = rng.choice(items)
        leak = edit(rng, item, rng.randint(0, int(0.16 * len(item))))
        texts.append(frames.words(rng, rng.randint(0, 60)) + leak + frames.words(rng, rng.randint(0, 60)))
    texts += [frames.words(rng, 100) for _ in range(50)]
    rows = dc.leaks(frames.documents(spark, texts), bench(spark, items)).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in rows}
    wanted = {
        (d, i): least_edits(item, text)
        for d, text in enumerate(texts)
        for i, item in enumerate(items)
        if len(item) <= len(text) + 20
    }
    wanted = {k: n for k, n in wanted.items() if n <= dc.budget(len(items[k[1]]))}
    assert len(wanted) > 100
    assert set(got) == set(wanted)
    for r in rows:
        stretch = texts[r["doc_id"]][r["start"] : r["end"]]
        assert least_edits(items[r["item_id"]], stretch) <= dc.budget(len(items[r["item_id"]]))
    kept = {r["doc_id"] for r in dc.without_leaks(frames.documents(spark, texts), bench(spark, items)).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in wanted}


def test_whole_and_repeated_passages(spark):
    rng = random.Random(12)
    item = "Ünïcode passage: " + frames.words(rng, 20)
    text = "é" * 30 + item.upper().replace("Ü", "Ü") + " middle " + item
    rows = dc.leaks(frames.documents(spark, [text, item, item[: len(item) // 2]]), bench(spark, [item, "short", None, ""])).collect()
    spots = sorted((r["doc_id"], r["start"]) for r in rows if r["edits"] == 0 or r["doc_id"] == 0)
    assert (1, 0) in spots and (0, text.rindex(item)) in spots
    assert {r["item_id"] for r in rows} == {0} and 2 not in {r["doc_id"] for r in rows}


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(13)
    items = [frames.words(rng, 20) for _ in range(20)]
    docs = frames.documents(spark, [i + " " + frames.words(rng, 30) for i in items])
    whole = sorted(dc.leaks(docs, bench(spark, items)).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1000)
    assert sorted(dc.leaks(docs, bench(spark, items)).collect()) == whole and len(whole) >= 20


@pytest.mark.parametrize("size", [8, 12, 40, 100, 1000])
def test_budget_keeps_the_bound_above_chance(size):
    k = dc.budget(size)
    assert k <= 0.1 * size
    assert k == 0 or size + 1 - dc.Q - k * dc.Q >= dc.LEAST


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    items = bench(spark, [frames.words(random.Random(1), 20), None, ""])
    assert dc.leaks(docs, items).count() == 0
    made = dc.without_leaks(docs, items)
    assert made.columns == docs.columns and made.count() == docs.count()
    assert dc.leaks(frames.empty(spark), items).count() == 0
    assert dc.leaks(docs, frames.empty(spark, "item_id long, text string")).count() == 0
    assert dc.without_leaks(docs, frames.empty(spark, "item_id long, text string")).count() == docs.count()


def test_a_long_item_of_which_a_text_holds_a_part_is_no_leak(spark):
    rng = random.Random(21)
    item = frames.words(rng, 6_700, 4_000)
    assert len(item) > 33_000
    docs = frames.documents(spark, [item[:9_600], "x " + edit(rng, item, 300) + " y", frames.words(rng, 50)])
    rows = dc.leaks(docs, bench(spark, [item])).collect()
    assert [r["doc_id"] for r in rows] == [1]
    assert 0 <= rows[0]["edits"] <= 300
    assert [r["doc_id"] for r in dc.without_leaks(docs, bench(spark, [item])).orderBy("doc_id").collect()] == [0, 2]


def test_edits_of_long_items_do_not_overflow():
    item, window = np.full(70_000, 1, np.uint8), np.full(70_100, 2, np.uint8)
    edits, _ = dc._align([item], [window], np.array([100_000]))
    assert edits[0] == 70_000
    assert dc._align([item], [window], np.array([50]))[0][0] == 51


def test_pairs_per_diagonal():
    rng = np.random.default_rng(3)
    text, item = np.sort(rng.choice(3_000, 900, False)), np.sort(rng.choice(700, 200, False))
    at, n = dc._pairs_per_diagonal(text, item)
    wanted, count = np.unique(text[:, None] - item[None], return_counts=True)
    assert np.array_equal(at, wanted) and np.array_equal(n, count)


@pytest.mark.parametrize("unfolded", [50, 1 << 20])
def test_repeated_grams_are_counted_alike(monkeypatch, unfolded):
    """The bound on unfolded pairs changes no cell."""
    rng = random.Random(5)
    items = dc.index([(0, "ab " * 40 + frames.words(rng, 20)), (1, frames.words(rng, 30) + " " * 60)])
    text = ("ab " * 300 + frames.words(rng, 40) + " " * 400 + items.texts[0].tobytes().decode()).encode()
    data = np.frombuffer(text * 2, np.uint8)
    chunk = dc.Chunk(0, data, np.array([0, len(text), 2 * len(text)]))
    whole = [sorted(zip(*x)) for x in [dc._candidates(chunk, data, items)]]
    monkeypatch.setattr(dc, "_UNFOLDED", unfolded)
    assert [sorted(zip(*x)) for x in [dc._candidates(chunk, data, items)]] == whole
    assert whole[0]


def test_a_text_of_blanks_against_an_item_of_blanks():
    import tracemalloc

    items = dc.index([(0, " " * 2_000)])
    data = np.full(1 << 20, 32, np.uint8)
    tracemalloc.start()
    found = dc._candidates(dc.Chunk(0, data, np.array([0, len(data)])), data, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) > 1_000 and peak < 600 << 20


def test_items_under_q_bytes_match_texts_that_are_the_item(spark):
    docs = frames.documents(spark, ["Yes.\n", "yes. and more", " 42", "42", "", None])
    items = bench(spark, ["yes.", "42", " ", "x"])
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in dc.leaks(docs, items).collect())
    assert got == [(0, 0, 0), (2, 1, 0), (3, 1, 0)]
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs, items).collect()) == [1, 4, 5]
