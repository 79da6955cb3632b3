import random

import pytest
from pyspark.sql import functions as F

from tests.llm import frames
from threadloom.llm import mixing


def test_targets_stop_at_three_times_the_source():
    got = mixing.targets({"b": 10, "a": 1000, None: 500})
    assert list(got) != [] and got["b"] == 30.0
    # weights: a 1, b 2, null 3; b is full at 30, the rest is shared 1 : 3
    assert got["a"] == pytest.approx(370.0) and got[None] == pytest.approx(1110.0)
    assert sum(got.values()) == pytest.approx(1510)


def test_flow_repeats_only_where_it_must():
    # pattern 0 serves both sources, pattern 1 only the second
    assert mixing.route([100, 100], [[0, 1], [1]], [150, 50]) == [150, 50]
    assert mixing.route([100, 100], [[0], [0, 1]], [150, 50]) == [100, 100]
    assert mixing.route([10], [[0]], [100]) == [30]


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(30):
        size = [rng.randint(1, 4) for _ in range(2)]
        quota = [rng.randint(0, 8) for _ in range(2)]
        member = [[0, 1], [rng.randint(0, 1)]]
        taken = mixing.route(size, member, quota)

        def price(x, cap):
            return sum(c * max(0, min(cap, x - i * cap)) for i, c in enumerate(mixing.COSTS))

        best = max(
            (
                (a + b + c, -(price(a + b, size[0]) + price(c, size[1])))
                for a in range(3 * size[0] + 1)
                for b in range(3 * size[0] + 1 - a)
                for c in range(3 * size[1] + 1)
                if a + (c if member[1] == [0] else 0) <= quota[0] and b + (c if member[1] == [1] else 0) <= quota[1]
            )
        )
        assert (sum(taken), -(price(taken[0], size[0]) + price(taken[1], size[1]))) == best


def test_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = [(i, frames.words(rng, rng.randint(0, 60)), "en", rng.choice(("a", "a", "a", "b", "c", None)), 0) for i in range(800)]
    docs = spark.createDataFrame(rows, frames.DOCS)
    made = {r["doc_id"]: r for r in mixing.report(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in mixing.report(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in made.items()}
    sizes, got, goal = {}, {}, {}
    for i, text, _, source, _ in rows:
        assert made[i]["size"] == len(text.split())
        assert made[i]["taken"] <= 3 * made[i]["size"]
        sizes[source] = sizes.get(source, 0) + made[i]["size"]
        got[source] = got.get(source, 0) + made[i]["taken"]
        goal[source] = made[i]["target"]
    assert goal == pytest.approx(mixing.targets(sizes))
    assert all(abs(got[s] - goal[s]) <= 1 for s in sizes)
    assert all(r["source_size"] == sizes[rows[i][3]] for i, r in made.items())


def test_overlapping_sources(spark):
    docs = frames.documents(spark, ["a b c d"] * 30).withColumn(
        "in", F.when(F.col("doc_id") < 10, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))
    )
    rows = mixing.mix(docs, F.col("in"), mixing.n_words(F.col("text"))).collect()
    taken = sum(r["size"] * r["copies"] + r["part"] for r in rows)
    assert taken == pytest.approx(sum(mixing.targets({"x": 120, "y": 40}).values()), abs=2)


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    assert mixing.report(docs).count() == docs.count()
    assert mixing.report(frames.empty(spark)).count() == 0
    made = mixing.mixture(docs)
    assert made.columns == [*docs.columns, "copies"]
    assert made.count() <= docs.count()
