import hashlib
import random
import re

import pytest

from tests.llm import frames
from threadloom.llm import line_dedup, registry


def line_key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def brute(rows):
    """{doc_id: sorted (n_lines, n_dropped, sha256) of its rows} of a table held in memory."""
    last = (True, 0)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line_key(line), set()).add(last if doc is None else (False, doc))
    out = {}
    for doc, text in rows:
        me, lines = last if doc is None else (False, doc), (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or min(holders[line_key(x)]) == me]
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.setdefault(doc, []).append((len(lines), len(lines) - len(kept), sha))
    return {k: sorted(v) for k, v in out.items()}


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["kept_sha256"]))
    return {k: sorted(v) for k, v in out.items()}


def corpus(rng, n=150):
    pool = [frames.words(rng, rng.randint(1, 6), 200) for _ in range(60)]
    pool += ["", " ", "\t", "short", "123456789", "1234567890", "ÉCOLE ÉTÉ ZÉRO", "école été zéro", "éCOLE éTÉ zÉRO", "x\r", "\x0blong enough\x0c", "LONG ENOUGH"]
    texts = ["\n".join(rng.choice(pool) + rng.choice(["", " ", "\r", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [*texts, "", "\n", "\n\n", texts[3], texts[4].upper()]


def test_equals_brute_force(spark):
    rows = list(enumerate(corpus(random.Random(3))))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(line_dedup.digest(docs))
    assert got == brute(rows)
    assert sum(v[0][1] for v in got.values()) > 300


@pytest.mark.parametrize("slices", [1, 3, 4096])
def test_a_hot_line_is_sliced(spark, monkeypatch, slices):
    monkeypatch.setattr(line_dedup, "SLICES", slices)
    hot = "the same line in every document"
    rows = [(700 - i, f"{hot}\nown line number {i}\n{hot.upper()} \n" + f"pair {i // 2} of lines") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(line_dedup.digest(docs)) == brute(rows)


def test_repeated_ids_null_ids_and_equal_rows(spark):
    line = "a line that is long enough"
    rows = [(1, f"{line}\nx"), (1, f"y\n{line}"), (2, line), (2, line), (None, line), (None, f"only in null ids\n{line}"), (None, "only in null ids"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_dedup.digest(docs)) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    docs = frames.awkward(spark)
    for name in ("pos", "t1", "n_lines", "kept_runs", "slice", "k1"):
        docs = docs.withColumn(name, docs["source"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(line_dedup.digest(docs)) == brute(rows)


def test_a_document_of_very_many_lines(spark):
    lines = [f"line number {i} of the long document" for i in range(60_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines)), (3, "\n".join(lines[1::2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_dedup.digest(docs)) == brute(rows)


def test_bitmaps_name_the_kept_lines(spark):
    a, b, c = ("first shared line", "second shared line", "third line alone")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{c}\n{b}\n\nend"), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["kept_runs"]] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {1: [(0, 2)], 2: [(1, 1), (3, 2)], 3: []}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()} == {1: f"{a}\n{b}", 2: f"{c}\n\nend", 3: ""}


def test_empty_table(spark):
    assert line_dedup.digest(frames.empty(spark)).collect() == []


def test_plan_has_no_python_and_one_shuffle_of_lines(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(random.Random(4)))), "doc_id long, text string")
    plan = line_dedup.digest(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_registered_query(spark):
    assert "op12_line_dedup" in registry.QUERIES and "op12_line_dedup" in registry.ORACLES
