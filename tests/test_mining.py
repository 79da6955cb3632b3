"""The reply walk on hand graphs, random graphs and forced join forms."""

import os
import random
from collections import Counter

import pytest

from threadloom.operators import fan_in, mining, reply_hop
from threadloom.plans import prepare

COLUMNS = (
    "tweet_id long, author_id string, text string, response_tweet_id string, "
    "in_response_to_tweet_id long"
)
GRAPH = [
    (1, "u", "a", "2,3", None), (2, "B", "b", "4", 1), (3, "u", "c", "5", 1),
    (4, "u", "d", None, 2), (5, "B", "e", None, 3),
    (10, "u", "f", "11,12", None), (11, "B", "g", None, 10),
    (20, "u", "h", "21,21", None), (21, "B", "i", None, 20),
    (30, "u", "j", "31", None), (31, None, "k", "32", 30), (32, "B", "l", None, 31),
    (40, "u", "m", "41", None), (41, "B", "n", "42", 40), (42, "u", "o", "41", 41),
    (50, "u", "p", None, None),
]


def brute_force(rows, max_depth=20):
    """Every sample of the graph by plain recursion."""
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    found = []

    def walk(message, sender, tweets, depth):
        if message[3] is None or depth == max_depth:
            return
        for piece in message[3].split(","):
            for reply in by_id.get(int(piece), []):
                known = sender[-1] is not None and reply[1] is not None
                if known and sender[-1] == reply[1]:
                    walk(reply, sender, [*tweets[:-1], tweets[-1] + " " + reply[2]], depth + 1)
                    continue
                if known:
                    found.append((tuple(sender), tuple(tweets), reply[2], reply[1]))
                walk(reply, [*sender, reply[1]], [*tweets, reply[2]], depth + 1)

    for r in rows:
        if r[4] is None and r[3] is not None:
            walk(r, [r[1]], [r[2]], 0)
    return Counter(found)


def bag(samples):
    return Counter(
        (tuple(r.sender), tuple(r.tweets), r.response, r.author_id) for r in samples.collect()
    )


def graph(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def random_graph(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        later = range(i + 1, min(n, i + 9))
        replies = rng.sample(later, min(len(later), rng.randint(0, 3)))
        if replies and rng.random() < 0.2:
            replies.append(replies[0])
        if rng.random() < 0.1:
            replies.append(n + i)
        listed = ",".join(map(str, replies)) or None
        author = rng.choice(["a", "b", "c", None] if rng.random() < 0.2 else ["a", "b"])
        parent = None if i < 5 or rng.random() < 0.05 else rng.randrange(i)
        rows.append((i, author, f"t{i}", listed, parent))
    return rows


def test_hand_graph(spark):
    got = bag(mining.mine(graph(spark, GRAPH), gate_english=False))
    assert got == brute_force(GRAPH)
    assert got[(("u",), ("a c",), "e", "B")] == 1
    assert got[(("u",), ("h",), "i", "B")] == 2
    cycle = [s for s in got if s[1][0].startswith("m")]
    assert len(cycle) == 20 and max(len(s[0]) for s in cycle) == 20


def test_walk_by_ids_gives_the_same(spark):
    rows = random_graph(5)
    got = bag(prepare.mine_by_ids(graph(spark, rows), 6, gate_english=False))
    assert got == brute_force(rows, 6)


def test_depth_bound_and_cut_chains(spark):
    levels = mining.mine_levels(graph(spark, GRAPH), max_depth=3, gate_english=False)
    assert bag(mining.samples_of(levels)) == brute_force(GRAPH, 3)
    assert mining.cut_by_depth(levels, 3).first().chains_cut == 1


def test_gate_cuts_what_hangs_below(spark):
    rows = [(1, "u", "hello", "2", None), (2, "B", "12345", "3", 1), (3, "u", "thanks", None, 2)]
    assert mining.mine(graph(spark, rows)).count() == 0
    assert mining.mine(graph(spark, rows), gate_english=False).count() == 2


def test_no_roots(spark):
    assert mining.mine(graph(spark, [(1, "u", "a", None, None)]), gate_english=False).count() == 0


def test_ids_tell_samples_apart(spark):
    samples = mining.mine(graph(spark, GRAPH), gate_english=False)
    assert samples.select("id").distinct().count() == samples.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rows = random_graph(seed)
    samples = mining.mine(graph(spark, rows).repartition(seed + 2), max_depth=8, gate_english=False)
    assert bag(samples) == brute_force(rows, 8)
    for r in samples.collect():
        assert len(r.sender) == len(r.tweets)
        assert all(a != b for a, b in zip(r.sender, r.sender[1:]))


@pytest.mark.parametrize("hot_rows", [0, 10**9])
def test_shuffled_and_salted_joins_give_the_same(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(reply_hop, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(reply_hop, "HOT_CHECK_ROWS", hot_rows)
    # One reply that most messages name, so that its id is hot.
    rows = [(i, "u", f"t{i}", "900", None) for i in range(40)]
    rows += [(900, "B", "yes", "901", 0), (901, "u", "ok", None, 900)] + GRAPH
    got = bag(mining.mine(graph(spark, rows), max_depth=4, gate_english=False))
    assert got == brute_force(rows, 4)


def test_long_reply_lists_in_parts(spark, monkeypatch):
    rows = [(1, "u", "hub", ",".join(map(str, range(2, 40))), None)]
    rows += [(i, "B", f"t{i}", str(i + 100), 1) for i in range(2, 40)]
    rows += [(i + 100, "u", f"r{i}", None, i) for i in range(2, 40)] + GRAPH[5:]
    whole = mining.mine(graph(spark, rows), gate_english=False).orderBy("id").collect()
    monkeypatch.setattr(reply_hop, "LIST_PART", 3)
    parts = mining.mine(graph(spark, rows), gate_english=False).orderBy("id").collect()
    assert whole == parts and len(whole) > 76
    merged = fan_in.mine_fan_in(graph(spark, rows), 5, gate_english=False)
    monkeypatch.setattr(reply_hop, "LIST_PART", 10**6)
    plain = fan_in.mine_fan_in(graph(spark, rows), 5, gate_english=False)
    assert merged.count() == plain.count() and merged.exceptAll(plain).count() == 0


def test_replies_are_not_shuffled_again(spark, monkeypatch):
    monkeypatch.setattr(reply_hop, "BROADCAST_BYTES", -1)
    messages = graph(spark, GRAPH)
    replies = reply_hop.reply_table(messages, ["author_id", "text"])
    replies.count()
    level = mining._roots_as_level(messages)
    hop = mining.next_hops(level, replies, reply_hop.Fan(10, 10, 2))
    plan = hop._jdf.queryExecution().executedPlan().toString()
    replies.unpersist()
    shown = plan.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in shown and "InMemoryTableScan" in shown
    assert shown.count("Exchange hashpartitioning") == 1


def test_progress(spark):
    levels = mining.mine_levels(graph(spark, GRAPH), max_depth=2, gate_english=False)
    rows = {r.depth: (r.chains, r.samples) for r in mining.progress_of(levels).collect()}
    assert rows == {0: (4, 5), 1: (1, 8)}


@pytest.mark.parametrize("seed", [2, 9])
def test_stored_replies_give_the_same(spark, seed):
    rows = random_graph(seed)
    rules = reply_hop.Rules(broadcast_bytes=-1, store=True)
    got = bag(mining.mine(graph(spark, rows), 6, gate_english=False, rules=rules))
    assert got == brute_force(rows, 6)


def test_stored_replies_are_neither_shuffled_nor_sorted(spark):
    messages = graph(spark, random_graph(3, 400))
    with reply_hop.reply_store(messages, ["author_id", "text"]) as replies:
        chains = spark.range(50).withColumnRenamed("id", "reply_id")
        fan = reply_hop.Fan(50, 1 << 30, 1)
        hop = reply_hop.join_replies(chains, chains, replies, fan, "reply_id", reply_hop.Rules(hot_rows=1 << 60, hot_bytes=1 << 60))
        plan = hop._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan") - 200 : plan.index("FileScan")]
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
        assert "Sort" not in side.split("\n")[-1]
        assert hop.count() == 50
        files = {f.rsplit("/", 1)[0] for f in replies.inputFiles()}
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    assert all(not os.path.exists(f.removeprefix("file:")) for f in files)


def test_a_cut_walk_warns(spark):
    with pytest.warns(UserWarning, match="depth bound of 3"):
        mining.mine_levels(graph(spark, GRAPH), max_depth=3, gate_english=False)
