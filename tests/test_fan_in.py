"""Merging walks and putting texts back."""

from threadloom.operators import fan_in, rehydrate, reply_hop
from threadloom.operators.reply_hop import Rules
from tests.test_mining import graph

# a and b, both by u, are answered by one reply, which c answers in turn.
FANS = [
    (1, "u", "first part here", "3", None),
    (2, "u", "second part here", "3", None),
    (3, "B", "one answer for both", "4,5", 1),
    (4, "u", "thank you very much", None, 3),
    (5, "v", "ok", None, 3),
    (6, "w", "another author asks", "3", None),
    (7, "x", "left hanging alone", "99", None),
]


def test_paths(spark):
    paths = fan_in.mine_fan_in(graph(spark, FANS), gate_english=False)
    got = {(tuple(r.sender), tuple(map(tuple, r.context)), r.response) for r in paths.collect()}
    assert got == {
        (("u",), ((1, 2),), 3),
        (("w",), ((6,),), 3),
        (("u", "B"), ((1, 2), (3,)), 4),
        (("u", "B"), ((1, 2), (3,)), 5),
        (("w", "B"), ((6,), (3,)), 4),
        (("w", "B"), ((6,), (3,)), 5),
    }
    assert paths.select("id").distinct().count() == 6


def test_self_responses_are_kept(spark):
    rows = [(1, "u", "a", "2", None), (2, "u", "b", None, 1)]
    assert fan_in.mine_fan_in(graph(spark, rows), gate_english=False).count() == 1


def test_rehydrate(spark):
    messages = graph(spark, FANS)
    paths = fan_in.mine_fan_in(messages, gate_english=False)
    known = messages.filter("tweet_id <> 6")
    got = {
        (tuple(r.sender), tuple(r.tweets), r.response)
        for r in rehydrate.rehydrate(paths, known).collect()
    }
    both = "first part here second part here"
    answer = "one answer for both"
    assert got == {
        (("u",), (both,), answer),
        (("w",), (None,), answer),
        (("u", "B"), (both, answer), "thank you very much"),
        (("w", "B"), (None, answer), "thank you very much"),
    }


def test_rehydrate_drops_unknown_responses(spark):
    messages = graph(spark, FANS)
    paths = fan_in.mine_fan_in(messages, gate_english=False)
    assert rehydrate.rehydrate(paths, messages.filter("tweet_id <> 4")).count() == 2


def test_merge_orders_by_place_then_id(spark):
    fans = spark.createDataFrame(
        [("", "u", 9, 2, 5, "b"), ("", "u", 9, 1, 7, "a"), ("", "u", 9, 2, 4, "c")],
        "context string, author_id string, next long, rpos int, tweet_id long, text string",
    )
    row = fan_in.merge_fans(fans).first()
    assert (row.tweet_ids, row.text, row.rpos) == ([7, 4, 5], "a c b", 1)


def test_running_list_shows_prefixes(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("abc")], "k int, i int, c string")
    got = rows.select("i", fan_in.running_list("c", ["k"], ["i"]).alias("cs")).orderBy("i")
    assert [r.cs for r in got.collect()] == [["a"], ["a", "b"], ["a", "b", "c"]]


def test_a_hop_shuffles_once_and_all_ways_agree(spark):
    messages = graph(spark, FANS)
    # two turns of one message each are not one turn of two
    level = spark.createDataFrame(
        [
            ([None, "u"], [[1], [2]], 0, 6, "w", [3]),
            (["u", None], [[1], [2]], 0, 7, "w", [3]),
            (["u"], [[1, 2]], 0, 8, "w", [3]),
            (["u"], [[1, 2]], 1, 9, "w", [3]),
        ],
        fan_in.PATH_LEVEL,
    )
    replies = reply_hop.reply_table(messages, ["author_id"])
    fan = reply_hop.Fan(4, 1 << 40, 1)
    ways = [Rules(), Rules(broadcast_bytes=-1, hot_rows=1 << 60, hot_bytes=1 << 60), Rules(broadcast_bytes=-1, hot_rows=0)]
    found = []
    for rules in ways:
        found.append({(tuple(r.sender), tuple(map(tuple, r.context))) for r in fan_in.next_hops(level, replies, fan, rules).collect()})
    assert found[0] == found[1] == found[2] == {
        ((None, "u", "w"), ((1,), (2,), (6,))),
        (("u", None, "w"), ((1,), (2,), (7,))),
        (("u", "w"), ((1, 2), (8, 9))),
    }
    plan = fan_in.next_hops(level, replies, fan, ways[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning(") == 1
    replies.unpersist()
