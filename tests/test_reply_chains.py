"""Roots, depths and cycles against walking every pointer."""

import random

import pytest

from threadloom.operators import reply_chains as R
from threadloom.session import Scratch


def walked(links):
    out = {}
    for start in links:
        path, at = [], start
        while at not in path and links.get(at) in links:
            path.append(at)
            at = links[at]
        if at in path:
            cycle = path[path.index(at) :]
            out[start] = (min(cycle), None, start in cycle)
        else:
            out[start] = (at, len(path), False)
    return out


def found(spark, links):
    rows = spark.createDataFrame(list(links.items()), "tweet_id long, in_response_to_tweet_id long").repartition(4)
    return {r["tweet_id"]: (r["root"], r["depth"], r["in_cycle"]) for r in R.reply_chains(rows).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = {k: rng.choice([None, rng.randrange(60), rng.randrange(90)]) for k in range(60)}
    assert found(spark, links) == walked(links)


def test_a_long_chain_and_a_long_cycle(spark):
    links = {0: None} | {k: k - 1 for k in range(1, 700)} | {k: k - 1 for k in range(1001, 1130)} | {1000: 1080, 5: 4, 2000: 2000}
    got = found(spark, links)
    assert got == walked(links)
    assert got[699] == (0, 699, False) and got[1129] == (1000, None, False) and got[2000] == (2000, None, True)


def test_a_hub_and_an_empty_table(spark):
    links = {0: 77} | {k: 0 for k in range(1, 400)} | {k: k - 300 for k in range(400, 600)}
    assert found(spark, links) == walked(links)
    empty = spark.createDataFrame([], "tweet_id long, in_response_to_tweet_id long")
    assert R.reply_chains(empty).collect() == []


class Counted(Scratch):
    def table(self, df, label):
        self.rounds = getattr(self, "rounds", 0) + (label == "moved")
        return super().table(df, label)


def test_rounds_follow_the_longest_cycle_and_chain(spark):
    rings = {k: k + 7 if k % 8 == 0 else k - 1 for k in range(4_096)}
    tails = {5_000 + k: 5_000 + k - 1 if k else 11 for k in range(20)}
    long_ring = {6_000 + k: 6_000 + (k + 1) % 300 for k in range(300)}
    for links, rounds in ((rings | tails, 7), (rings | long_ring, 11)):
        rows = spark.createDataFrame(list(links.items()), "tweet_id long, in_response_to_tweet_id long").repartition(4)
        tables = Counted(spark, "counted")
        made = R.reply_chains(rows, tables=tables)
        assert {r["tweet_id"]: (r["root"], r["depth"], r["in_cycle"]) for r in made.collect()} == walked(links)
        assert tables.rounds <= rounds
