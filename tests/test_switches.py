"""Both ways of every size switch give the same rows, also for awkward input."""

import random
import re

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import authors, embeddings, mining, packing, ranking
from threadloom.plans import prepare
from threadloom.session import Scratch, scratch, shared_folder
from threadloom.sources import files

MESSAGES = "tweet_id long, author_id string, text string, response_tweet_id string, in_response_to_tweet_id long"


def rows_of(frame):
    return frame.columns, sorted(map(repr, frame.collect()))


def test_speaker_classes(spark):
    samples = spark.createDataFrame(
        [(1, ["a", "x"], "a"), (1, ["x"], "b"), (2, [], "x"), (3, None, None), (4, ["x", None, "a"], "b"), (1, ["a", "x"], "a")],
        "id long, sender array<string>, author_id string",
    )
    accounts = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "author_id string, code int")
    near = authors.speaker_classes(samples, accounts)
    joined = authors.speaker_classes(samples, accounts, inline=0)
    assert rows_of(near) == rows_of(joined)
    assert near.columns == ["id", "sender", "author_id", "sender_class", "author_class"]
    assert near.count() == samples.count()


def test_a_repeated_name_has_its_last_code(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "author_id string")
    accounts = spark.createDataFrame([("a", 1), ("a", 7)], "author_id string, code int")
    assert {r.author_id: r.author_code for r in authors.encode_authors(rows, accounts).collect()} == {"a": 7, "z": 0}


def test_mean_pool(spark):
    rows = spark.createDataFrame(
        [(1, [1, 2, 0]), (1, [2, 2]), (2, []), (3, None), (4, [9]), (5, [0, None, 1])], "k long, ids array<int>"
    )
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 0.5]), (2, [4.0, 0.0]), (3, None)], "id int, vector array<double>")
    near = embeddings.mean_pool(rows, table)
    assert rows_of(near) == rows_of(embeddings.mean_pool(rows, table, matrix_values=0))
    assert near.columns == ["k", "ids", "pooled"]


def test_lanes_on_either_side(spark, monkeypatch):
    def side(n):
        return spark.range(n).select(F.lit(0).alias("batch_id"), F.col("id").alias("slot"), F.array(F.col("id") * 1.0).alias("vector"))

    for contexts, responses in ((5, 90), (90, 5), (40, 40)):
        plain = rows_of(ranking.score_matrix(side(contexts), side(responses)))
        monkeypatch.setattr(ranking, "LANE_ROWS", 16)
        assert rows_of(ranking.score_matrix(side(contexts), side(responses))) == plain
        assert len(plain[1]) == contexts * responses
        monkeypatch.undo()


def test_a_task_emits_its_best_once(spark):
    contexts = spark.range(10).select(F.col("id").alias("context_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"))
    responses = spark.range(3000).select(F.col("id").alias("response_id"), F.array(F.lit(1.0), F.rand(3)).alias("vector"))
    responses = responses.union(spark.createDataFrame([(9999, None)], "response_id long, vector array<double>")).coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = ranking._shared_contexts(contexts, responses.filter("vector is not null"), 3, "context_id long, response_id long, score double", None)
        assert found.count() <= 10 * 3 * 2
        near = ranking.select_responses(contexts, responses, 3)
        assert rows_of(near) == rows_of(ranking.select_responses(contexts, responses, 3, context_values=0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lists_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n z \n\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("w\nx\n\n\n", encoding="utf-8")
    got = {r.author_id: r.code for r in files.read_authors(spark, str(tmp_path)).collect()}
    assert got == {"y": 2, "z": 3, "": 4, "w": 5, "x": 6}


def test_a_bad_cell_is_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "tweet_id,author_id,inbound,text,response_tweet_id,in_response_to_tweet_id\nx1,a,maybe,hi,2,\n2,b,True,yo,,1\n", encoding="utf-8"
    )
    rows = files.parquet_copy(spark, str(tmp_path / "m.csv"), str(tmp_path / "copy")).orderBy("text").collect()
    assert [(r.tweet_id, r.inbound, r.text) for r in rows] == [(None, None, "hi"), (2, True, "yo")]


def test_feed_does_not_follow_the_row_count(spark):
    few = packing.batch_feed(spark.range(50), "id", buckets=4).select("id", "bucket")
    many = packing.batch_feed(spark.range(90), "id", buckets=4).select("id", "bucket")
    assert set(map(tuple, few.collect())) <= set(map(tuple, many.collect()))


def test_scratch_leaves_nothing_behind(spark):
    jvm = spark.sparkContext._jvm
    with scratch(spark, "trial") as tables:
        frame = tables.table(spark.range(3), "numbers")
        assert frame.count() == 3
        path = jvm.org.apache.hadoop.fs.Path(tables.root)
        disk = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert disk.exists(path)
    assert not disk.exists(path)
    kept = Scratch(spark, "kept")
    first = kept.table(spark.range(2), "first")
    kept.drop(first)
    assert kept.root.startswith(shared_folder(spark))


def test_names_tree_is_the_alternation():
    rng = random.Random(7)
    for _ in range(300):
        names = ["".join(rng.choice("ab.") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        plain = re.compile("|".join(map(re.escape, names)))
        tree = re.compile(text.names_pattern(names))
        for _ in range(10):
            probe = "".join(rng.choice("ab.") for _ in range(6))
            want, got = plain.match(probe), tree.match(probe)
            assert (want and want.group()) == (got and got.group()), (names, probe)


def test_no_depth_gives_no_samples(spark):
    messages = spark.createDataFrame([(1, "a", "hi there", "2", None), (2, "b", "yes ok", None, 1)], MESSAGES)
    assert mining.mine(messages, max_depth=0).count() == 0


def test_a_missing_text_makes_its_turn_null_in_both_walks(spark):
    messages = spark.createDataFrame(
        [(1, "a", None, "2", None), (2, "a", "hi", "3", 1), (3, "b", "yo", "4", 2), (4, "a", "so", None, 3)], MESSAGES
    )
    both = [f(messages, gate_english=False).select("tweets", "response") for f in (mining.mine, prepare.mine_by_ids)]
    assert rows_of(both[0]) == rows_of(both[1])
