"""Padding, packing, split and batches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import arrays as A
from threadloom.operators import authors, packing, subwords
from threadloom.plans import prepare

SAMPLES = "id string, sender array<string>, tweets array<string>, response string, author_id string"


@pytest.fixture
def encoder(spark):
    merges = spark.createDataFrame([(0, "▁", "a")], subwords.MERGES)
    counts = spark.createDataFrame([("▁ab", 1)], "word string, n long")
    return subwords.TurnEncoder(merges, subwords.vocabulary(counts, merges))


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([("B", 1)], "author_id string, code int")


def test_left_pad(spark):
    rows = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5, 6, 7],), ([],)], "ids array<int>")
    got = [r.out for r in rows.select(A.left_pad("ids", 5).alias("out")).collect()]
    assert got == [[0, 0, 0, 1, 2], [3, 4, 5, 6, 7], [0, 0, 0, 0, 0]]


def test_pack(spark, encoder, accounts):
    samples = spark.createDataFrame([("s", ["u", "B"], ["ab", "b"], "ab ab", "B")], SAMPLES)
    row = packing.pack(samples, encoder, accounts, ["B"], length=16).first()
    # ▁a is 3; a, b and ▁ are equally frequent, so 4, 5 and 6; '' is 12.
    assert row.context == [0] * 6 + [1, 3, 5, 12, 2] + [1, 6, 5, 12, 2]
    assert row.sender_ids == [0] * 6 + [1] * 5 + [2] * 5
    assert row.response_ids == [0] * 9 + [1, 3, 5, 3, 5, 12, 2]
    assert row.author_ids == [0] * 9 + [2] * 7


def test_long_responses_are_dropped_and_long_contexts_cut(spark, encoder, accounts):
    fits, over = " ".join(["a"] * 67), " ".join(["a"] * 68)
    samples = spark.createDataFrame(
        [("fits", ["u"], [over * 3], fits, "B"), ("over", ["u"], ["a"], over, "B")], SAMPLES
    )
    rows = packing.pack(samples, encoder, accounts, ["B"]).collect()
    assert [r.id for r in rows] == ["fits"]
    assert all(len(rows[0][p]) == 128 for p in packing.ROW_PARTS)
    assert sum(x != 0 for x in rows[0].response_ids) == 70
    assert 0 not in rows[0].context


def test_encoding_runs_once(spark, encoder, accounts):
    samples = spark.createDataFrame([("s", ["u"], ["ab"], "ab", "B")], SAMPLES)
    packed = packing.pack(samples, encoder, accounts, ["B"])
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_one_bad_turn_drops_the_sample(spark):
    samples = spark.createDataFrame(
        [
            ("good", ["u"], ["hello"], "yes", "B"),
            ("spanish", ["u", "B"], ["hello", "la casa"], "yes", "u"),
            ("empty", ["u"], [""], "yes", "B"),
            ("answer", ["u"], ["hello"], "en casa", "B"),
            ("nothing", ["u"], ["hello"], "", "B"),
        ],
        SAMPLES,
    )
    assert [r.id for r in packing.valid_samples(samples).collect()] == ["good"]
    reasons = {r.id: r.reject_reason for r in packing.with_reject_reason(samples).collect()}
    assert reasons == {
        "good": None,
        "spanish": "spanish turn",
        "empty": "empty turn",
        "answer": "spanish response",
        "nothing": "empty response",
    }


def test_lines_round_trip_and_bad_lines(spark):
    good = ",".join(map(str, range(512)))
    rows = spark.createDataFrame([(good,), ("1,2,3",), (good.replace("7", "x"),)], "line string")
    got = packing.unpack_lines(rows).collect()
    assert got[0].context == list(range(128)) and got[0].author_ids == list(range(384, 512))
    assert got[0].bad_record is None
    assert got[1].bad_record == "1,2,3" and got[1].context is None
    assert got[2].bad_record is not None


def test_speaker_classes_by_list_and_by_join(spark, accounts, monkeypatch):
    samples = spark.createDataFrame(
        [("s", ["u", "B", "u"], ["a"] * 3, "r", "B"), ("t", ["B"], ["a"], "r", None)], SAMPLES
    )

    def classes():
        rows = authors.speaker_classes(samples, accounts).orderBy("id").collect()
        return [(r.sender_class, r.author_class) for r in rows]

    listed = classes()
    assert listed == [([1, 2, 1], 2), ([2], 1)]
    monkeypatch.setattr(authors, "INLINE_ACCOUNTS", 0)
    assert classes() == listed


def test_split_is_stable_and_rare(spark):
    rows = spark.range(40_000).withColumnRenamed("id", "key")
    split = packing.assign_split(rows, "key")
    share = split.filter("split = 'test'").count() / 40_000
    assert 0.002 < share < 0.004
    again = packing.assign_split(rows.repartition(3), "key")
    assert split.exceptAll(again).count() == 0


def test_batches(spark):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    fed = packing.batch_feed(rows, "key", batch_size=32, buckets=3)
    sizes = fed.groupBy("bucket", "batch_no").agg(F.count("*").alias("n"), F.max("slot").alias("s"))
    per_bucket = fed.groupBy("bucket").count().collect()
    assert sum(r["count"] for r in per_bucket) == 1000
    expected = sum(math.ceil(r["count"] / 32) for r in per_bucket)
    found = sizes.collect()
    assert len(found) == expected and all(r.n == r.s + 1 <= 32 for r in found)
    other = packing.batch_feed(rows, "key", buckets=3, epoch=1)
    assert fed.select("key", "bucket", "batch_no").exceptAll(
        other.select("key", "bucket", "batch_no")
    ).count()


def test_lines_are_read_once_per_row(spark):
    good, size = ",".join(["+4", " 5", "-1", "007"] * 4), 4
    lines = spark.createDataFrame([(x,) for x in (good, good + ",1", good.replace("+4", "x"), "", None)], "line string")
    rows = packing.unpack_lines(lines, size)
    part = [4, 5, -1, 7]
    assert [[r[p] for p in packing.ROW_PARTS] for r in rows.collect()] == [[part] * 4] + [[None] * 4] * 4
    assert [r.bad_record is None for r in rows.collect()] == [True, False, False, False, True]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("exists(") == 1 and "transform(" not in plan


class Counting:
    """Counts the turns that it encodes; its ids are a start, the lengths of the words, and an end."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def encode_turns(self, turns):
        seen = self.seen

        @F.udf("array<array<int>>")
        def encode(texts):
            seen.add(len(texts))
            return [[1, *map(len, t.split()), 2] for t in texts]

        return encode.asNondeterministic()(turns)

    def encode(self, text):
        return F.element_at(self.encode_turns(F.array(text)), 1)


@pytest.mark.parametrize("shelf", [1, 40, 65_536])
def test_prepared_turns_are_encoded_once_each(spark, accounts, monkeypatch, shelf):
    monkeypatch.setattr(packing, "SHELF_TURNS", shelf)
    rng = random.Random(8)
    said = ["hello there", "yes", "la casa", "", None, *(f"word{i} and more" for i in range(20))]
    pick = [0.2 if t in (None, "", "la casa") else 5 for t in said]
    rows = []
    for i in range(120):
        n = rng.randrange(0, 6)
        rows.append((f"s{i}", ["u", "B", "c"][:n], rng.choices(said, pick, k=n), rng.choices(said, pick)[0], "B"))
    samples = spark.createDataFrame([*rows, ("none", None, None, "yes", "B"), ("null", ["u"], ["yes"], None, None)], SAMPLES).repartition(3)
    encoder = Counting(spark)
    got = prepare._packed(samples, encoder, accounts, ["B"], "strict", 32).collect()
    texts = {t for _, _, tweets, response, _ in rows for t in [*tweets, response]} - {None, "", "la casa"}
    assert encoder.seen.value == len(texts)
    assert sorted(got) == sorted(packing.pack(samples, Counting(spark), accounts, ["B"], length=32).collect())
    assert sorted(got) == sorted(packing.pack(samples, Counting(spark), accounts, ["B"], length=32, once=True).collect())
    assert len(got) > 50
