"""Scores, losses, selection and pooling against numpy."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import vectors as L
from threadloom.operators import embeddings, metrics, ranking


def vectors(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    data = rng.integers(-3, 4, (n, dim)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>"), data


@pytest.mark.parametrize("context_values", [10**6, 0])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_selection_with_many_ties(spark, monkeypatch, context_values, k):
    monkeypatch.setattr(ranking, "CONTEXT_BLOCK", 7)
    monkeypatch.setattr(ranking, "RESPONSE_BLOCK", 50)
    contexts, c = vectors(spark, 20, 3, 1, "context_id")
    responses, r = vectors(spark, 300, 3, 2, "response_id")
    got = ranking.select_responses(contexts, responses, k, context_values).collect()
    found = {(x.context_id, x.rank): (x.response_id, x.score) for x in got}
    scores = c @ r.T
    for i in range(20):
        order = sorted(range(300), key=lambda j: (-scores[i, j], j))[:k]
        assert [found[i, n + 1] for n in range(len(order))] == [(j, scores[i, j]) for j in order]
    assert len(got) == 20 * min(k, 300)


def test_selection_from_nothing(spark):
    contexts, _ = vectors(spark, 2, 3, 1, "context_id")
    responses, _ = vectors(spark, 2, 3, 1, "response_id")
    assert ranking.select_responses(contexts.limit(0), responses, 2).count() == 0
    assert ranking.select_responses(contexts, responses.limit(0), 2).count() == 0


def numpy_loss(s, margin):
    b = len(s)
    pos = np.diag(s)
    negative = 1 - np.eye(b)
    relevant = (s - pos[:, None] + margin > 0) * negative
    n = relevant.sum(1)
    mean = np.divide((s * relevant).sum(1), n, out=np.zeros(b), where=n > 0)
    loss = np.where(n > 0, np.maximum(mean - pos + margin, 0), 0)
    every = np.maximum((s * negative).sum(1) / (b - 1) - pos + margin, 0)
    return loss.mean(), every.mean(), int((n == 0).sum())


@pytest.mark.parametrize("margin", [0.5, 0.05])
def test_triplet_loss(spark, margin):
    rng = np.random.default_rng(3)
    s = rng.random((9, 9))
    s[0, 0] = 3.0  # an anchor no negative comes near
    rows = [(1, i, j, float(s[i, j])) for i in range(9) for j in range(9)]
    scores = spark.createDataFrame(rows, "batch_id long, i int, j int, score double")
    got = ranking.triplet_loss(scores, margin).first()
    loss, every, empty = numpy_loss(s, margin)
    assert got.loss == pytest.approx(loss) and got.all_loss == pytest.approx(every)
    assert got.no_hard == empty and empty >= 1
    triplets = ranking.hard_triplets(scores, margin)
    assert triplets.count() == got.n_relevant
    assert triplets.filter("kind = 'hard' and negative_score <= positive_score").count() == 0


@pytest.mark.parametrize("lane_rows", [1024, 5])
def test_score_matrix_of_uneven_batches(spark, monkeypatch, lane_rows):
    monkeypatch.setattr(ranking, "LANE_ROWS", lane_rows)
    rng = np.random.default_rng(4)
    sizes = {0: 23, 1: 3, 2: 6}
    c = {b: rng.random((n, 4)) for b, n in sizes.items()}
    r = {b: rng.random((n, 4)) for b, n in sizes.items()}

    def side(data):
        rows = [(b, i, [float(x) for x in v]) for b, m in data.items() for i, v in enumerate(m)]
        return spark.createDataFrame(rows, "batch_id long, slot int, vector array<double>")

    got = ranking.score_matrix(side(c), side(r)).collect()
    assert len(got) == sum(n * n for n in sizes.values())
    for x in got:
        assert x.score == pytest.approx(c[x.batch_id][x.i] @ r[x.batch_id][x.j])


def test_single_pair_batch_has_no_loss(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.3)], "batch_id long, i int, j int, score double")
    got = ranking.triplet_loss(scores).first()
    assert (got.loss, got.all_loss, got.no_hard) == (0.0, 0.0, 1)


def test_pooling_in_place_and_by_join(spark, monkeypatch):
    table = spark.createDataFrame(
        [(i, [float(i), float(i * i)]) for i in range(6)], "id int, vector array<float>"
    )
    rows = spark.createDataFrame(
        [(1, [0, 0, 2, 4]), (2, [5, 5, 1]), (3, [0, 0]), (4, [3, 77])], "k int, ids array<int>"
    )

    def pooled():
        return {r.k: r.pooled for r in embeddings.mean_pool(rows, table).collect()}

    in_place = pooled()
    assert in_place == {1: [3.0, 10.0], 2: [11 / 3, 17.0], 3: None, 4: [3.0, 9.0]}
    monkeypatch.setattr(embeddings, "MATRIX_VALUES", 0)
    joined = pooled()
    assert joined.keys() == in_place.keys()
    for k, v in in_place.items():
        assert joined[k] == (pytest.approx(v) if v else None)


def test_pooling_runs_once(spark):
    table = spark.createDataFrame([(1, [1.0])], "id int, vector array<float>")
    rows = spark.createDataFrame([(1, [1])], "k int, ids array<int>")
    pooled = embeddings.mean_pool(rows, table).select(F.explode("pooled"))
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_embedding_table_is_complete_and_repeatable(spark):
    known = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, vector array<float>")
    rows = embeddings.embedding_table(known, 2000, 3, seed=5)
    got = {r.id: r.vector for r in rows.collect()}
    assert sorted(got) == list(range(2000)) and got[1] == [1.0, 2.0, 3.0]
    again = {r.id: r.vector for r in rows.repartition(3).collect()}
    assert got == again
    drawn = np.array([v for i, v in got.items() if i != 1])
    assert abs(drawn.mean()) < 0.05 and abs(drawn.std() - 1) < 0.05
    flat = embeddings.embedding_table(known, 500, 3, init="uniform").filter("id <> 1")
    assert max(abs(x) for r in flat.collect() for x in r.vector) <= 0.05


def test_word_vectors(spark):
    rows = spark.createDataFrame([([1, 7, 8, 2],), ([1, 8, 2],)], "ids array<int>")
    got = embeddings.train_word_vectors(embeddings.digit_sentences(rows), dim=4, partitions=1)
    assert sorted(r.id for r in got.collect()) == [1, 2, 7, 8]
    assert all(len(r.vector) == 4 for r in got.collect())


def test_logistic(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    got = rows.select(L.logistic("v", [0.5, -1.0], 0.25).alias("p")).first().p
    assert got == pytest.approx(1 / (1 + np.exp(1.25)))


def test_rollup_reports_at_step_zero(spark):
    rows = spark.createDataFrame(
        [(0, i, float(i), 0.0) for i in range(120)], "epoch int, step int, loss double, all_loss double"
    )
    got = metrics.metric_rollup(rows).orderBy("report").collect()
    assert [(r.report, r.steps, r.loss, r.reported) for r in got] == [
        (0, 1, 0.0, True),
        (1, 50, 25.5, True),
        (2, 50, 75.5, True),
        (3, 19, 110.0, False),
    ]


def test_weighted_cross_entropy(spark):
    rows = spark.createDataFrame(
        [([1.0, 2.0, 3.0], 2, 1), ([500.0, 0.0, 0.0], 0, 1), ([1.0, 1.0, 1.0], 1, 0)],
        "logits array<double>, target int, weight int",
    )
    got = metrics.weighted_cross_entropy(rows).first()
    ce = np.log(np.exp([1, 2, 3]).sum()) - 3
    assert got.loss == pytest.approx(ce / 3) and got.metric == pytest.approx(ce / 2)
    none = metrics.weighted_cross_entropy(rows.withColumn("weight", F.lit(0))).first()
    assert none.metric is None


def test_sums_gather_a_block_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    matrix = rng.random((50, 64), np.float32)
    owner, place = np.sort(rng.integers(0, 40, 200_000)), rng.integers(0, 50, 200_000)
    monkeypatch.setattr(embeddings, "BLOCK_VALUES", 64 * 1000)
    tracemalloc.start()
    found = embeddings._sums(owner, place, matrix, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = np.array([matrix[place[owner == k]].astype(float).sum(axis=0) for k in range(40)])
    assert np.allclose(found, wanted)
    assert peak < 4_000_000  # all vectors at once are 100 MB


def test_joined_pooling_sends_a_vector_once_a_shelf(spark, monkeypatch):
    """Rows longer than a shelf, missing ids and numbers, and vectors of several lengths."""
    rows = [(k, [(k * i) % 9 if i % 5 else None for i in range(k % 40)]) for k in range(60)] + [(99, None), (98, [])]
    vectors = {i: [float(i), None if i == 4 else i / 8, *([1.0] if i == 5 else [])] for i in range(7)}
    frame = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    table = spark.createDataFrame(list(vectors.items()), "id int, vector array<double>")
    monkeypatch.setattr(embeddings, "SHELF_VALUES", 2 * 16)
    pooled = embeddings.mean_pool(frame, table, matrix_values=0)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(vector" not in plan and "FlatMapCoGroupsInArrow" in plan
    found = {r.k: r.pooled for r in pooled.collect()}
    assert len(found) == len(rows)
    for k, ids in rows:
        used = [vectors[i] for i in ids or [] if i and i in vectors]
        wanted = []
        for dim in range(max(map(len, used), default=0)):
            has = [v[dim] for v in used if len(v) > dim]
            known = [x for x in has if x is not None]
            wanted.append(pytest.approx(sum(known) / len(has)) if known else None)
        assert found[k] == (wanted or None)
