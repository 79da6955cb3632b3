"""The inverted file against the exact selection."""

import numpy as np
import pytest

from threadloom.operators import inverted_file as I
from threadloom.operators import ranking


def sides(spark, n=1500, dim=16, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    responses = centers[rng.integers(0, groups, n)] + 0.5 * rng.normal(size=(n, dim))
    contexts = centers[rng.integers(0, groups, 200)] + 0.5 * rng.normal(size=(200, dim))
    left = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(contexts)] + [(900, None)], "context_id long, vector array<double>")
    right = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(responses)] + [(5000, None)], "response_id long, vector array<double>")
    return left, right.repartition(5)


def rows(frame):
    return sorted((r["context_id"], r["rank"], r["response_id"], round(r["score"], 9)) for r in frame.collect())


def test_recall_against_the_exact_selection(spark):
    contexts, responses = sides(spark)
    exact = ranking.select_responses(contexts, responses, 5)
    few = I.select_responses_indexed(contexts, responses, 5, cells=30, probes=4, sample=600)
    assert I.recall(few, exact) >= 0.9
    scores = {(r["context_id"], r["response_id"]): r["score"] for r in few.collect()}
    vectors = [{r[0]: np.array(r["vector"]) for r in side.filter("vector is not null").collect()} for side in (contexts, responses)]
    assert all(s == pytest.approx(vectors[0][c] @ vectors[1][r]) for (c, r), s in scores.items())


@pytest.mark.parametrize("block,lane", [(20_000, 2_000), (40, 2_000), (40, 30)])
def test_all_cells_give_the_exact_selection(spark, monkeypatch, block, lane):
    monkeypatch.setattr(I, "LANE", lane)
    contexts, responses = sides(spark, 600)
    index = I.ResponseIndex(responses, 8, block=block)
    assert rows(index.select(contexts, 4, probes=8)) == rows(ranking.select_responses(contexts, responses, 4))


def test_equal_vectors_and_empty_sides(spark):
    contexts, responses = sides(spark, 50)
    same = responses.sparkSession.createDataFrame([(k, [1.0] * 16) for k in range(40)], "response_id long, vector array<double>")
    assert len(I.learn_cells(same, 5)) == 1
    assert rows(I.select_responses_indexed(contexts, same, 2, 5, 1)) == rows(ranking.select_responses(contexts, same, 2))
    assert I.select_responses_indexed(contexts, responses.limit(0), 3, 4, 2).collect() == []
    assert I.select_responses_indexed(contexts.limit(0), responses, 3, 4, 2).collect() == []


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    contexts = table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "context_id")
    responses = table.withColumnRenamed("vec_id", "response_id")
    exact = ranking.select_responses(contexts, responses, 5)
    found = I.select_responses_indexed(contexts, responses, 5, cells=32, probes=20)
    got = I.recall(found, exact)
    print("recall", got)
    assert got >= 0.9
