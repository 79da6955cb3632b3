"""Global positions, feeds and folds against sorted lists."""

import hashlib
import random

import pytest

from threadloom.operators import fan_in
from threadloom.operators import numbering as N


def test_places_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = N.numbered(frame, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows)
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def digest(epoch, key):
    return hashlib.md5(f"1234:{epoch}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000])
def test_feed_has_one_short_batch(spark, n):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(n)], "id int, text string").repartition(4)
    got = [(r["batch_no"], r["slot"], r["id"], r["text"]) for r in N.global_feed(rows).collect()]
    wanted = sorted(range(n), key=lambda k: (digest(0, k), k))
    assert sorted(got) == [(i // 32, i % 32, k, f"t{k}") for i, k in enumerate(wanted)]


def test_feed_resumes_and_changes_with_the_epoch(spark):
    rows = spark.range(500).withColumnRenamed("id", "key")
    whole = N.global_feed(rows, "key", batch_size=16, epoch=2)
    later = N.global_feed(rows, "key", batch_size=16, epoch=2, start_batch=20)
    assert sorted(map(tuple, later.collect())) == sorted(tuple(r) for r in whole.collect() if r["batch_no"] >= 20)
    feeds = N.feed_epochs(rows, 2, "key", 16).collect()
    firsts = [sorted((r["slot"], r["key"]) for r in feeds if r["epoch"] == e and r["batch_no"] == 0) for e in (0, 1)]
    assert firsts[0] != firsts[1]
    assert len(feeds) == 1000


def test_list_parts_of_a_group_of_most_rows(spark):
    rows = [(None if k % 3 else "x", 2_000 - k, f"v{k}") for k in range(2_000)]
    frame = spark.createDataFrame(rows, "g string, o int, v string").repartition(6)
    parts = N.list_parts(frame, ["g"], ["o"], ["v"], part=64).collect()
    assert all(len(r["v"]) <= 64 for r in parts)
    for g in (None, "x"):
        own = sorted((r for r in parts if r["g"] == g), key=lambda r: r["part"])
        assert [v for r in own for v in r["v"]] == [v for _, v in sorted((o, v) for h, o, v in rows if h == g)]
        assert all(len(r["v"]) == 64 for r in own[:-1])


def test_merged_parts_are_the_merged_fan(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(3)}", f"a{rng.randrange(2)}", rng.randrange(4), rng.randrange(9), k, f"t{k}") for k in range(600)]
    fans = spark.createDataFrame(rows, "context string, author_id string, next long, rpos int, tweet_id long, text string")
    whole = {(r["context"], r["author_id"], r["next"]): (r["rpos"], r["tweet_ids"], r["text"]) for r in fan_in.merge_fans(fans).collect()}
    parts = {}
    for r in sorted(N.merged_parts(fans, part=7).collect(), key=lambda r: r["part"]):
        parts.setdefault((r["context"], r["author_id"], r["next"]), []).append(r)
    got = {k: (v[0]["rpos"], [i for r in v for i in r["tweet_ids"]], " ".join(r["text"] for r in v)) for k, v in parts.items()}
    assert got == whole
