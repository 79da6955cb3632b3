"""Root, depth and cycles of messages by pointer jumping.

Every message points to the one it answers. In a round each pointer moves to where
its target points, so pointers that are not at a root after k rounds span 2**k
messages. A chain of a million replies takes 20 rounds. What pointers without a root
point to becomes fewer in each round until only cycles are left: a round after which
it is as much as before, and in which no pointer met a lower id, was the last. So
rounds follow the longest chain or cycle, not the number of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch


def _jumped(open_: DataFrame, asked: DataFrame, state: DataFrame) -> DataFrame:
    """One round: open pointers move to where their targets, ``asked``, point."""
    answers = state.join(asked, "tweet_id").select(
        F.col("tweet_id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("rooted").alias("ends"), F.col("least").alias("low")
    )
    return open_.drop("rooted").join(answers, "up").select(
        "tweet_id",
        F.col("far").alias("up"),
        (F.col("steps") + F.col("more")).alias("steps"),
        F.col("ends").alias("rooted"),
        F.least("least", "low").alias("least"),
        (F.col("low") < F.col("least")).alias("fell"),
    )


def reply_chains(messages: DataFrame, parent: str = "in_response_to_tweet_id", tables: Scratch | None = None) -> DataFrame:
    """``(tweet_id, root, depth, in_cycle)`` of every message.

    A message that answers none, or one that is not in the table, is a root of depth 0.
    A message on a cycle has the cycle's least id as root; one below a cycle has that,
    too. Neither has a depth, and only the former is ``in_cycle``. Ids are unique.
    """
    tables = tables or Scratch(messages.sparkSession, "chains")
    ids = messages.filter("tweet_id is not null").select(F.col("tweet_id").cast("long").alias("tweet_id"), F.col(parent).cast("long").alias("up"))
    known = ids.select(F.col("tweet_id").alias("up"), F.lit(True).alias("known"))
    linked = ids.join(known, "up", "left")
    start = linked.select(
        "tweet_id",
        F.coalesce(F.when(F.col("known"), F.col("up")), "tweet_id").alias("up"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"),
        F.col("known").isNull().alias("rooted"),
        F.when(F.col("known"), F.least("tweet_id", "up")).otherwise(F.col("tweet_id")).alias("least"),
        F.lit(True).alias("fell"),
    )
    # a round's table holds the pointers that were open; what got a root in it stays as it is
    parts, span = [tables.table(start, "start")], 1
    before = None
    while True:
        open_ = parts[-1].filter("not rooted")
        left, fell = open_.agg(F.count("*"), F.coalesce(F.count_if("fell"), F.lit(0))).first()
        if not left or span >= 2 * left:
            break
        asked = tables.table(open_.select(F.col("up").alias("tweet_id")).distinct(), "asked")
        targets = asked.count()
        if targets == before and not fell:
            break
        state = parts[-1]
        for rows in parts[:-1]:
            state = state.unionByName(rows.filter("rooted"))
        parts.append(tables.table(_jumped(open_, asked, state), "moved"))
        span, before = 2 * span, targets
    open_ = parts[-1].filter("not rooted")
    parts = [rows.filter("rooted") for rows in parts]
    found = parts[0]
    for rows in parts[1:]:
        found = found.unionByName(rows)
    made = found.select("tweet_id", F.col("up").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("in_cycle"))
    if not left:
        return made
    # after so many rounds, every pointer stands on a cycle, and every message of one is stood on
    on_cycle = open_.select(F.col("up").alias("tweet_id")).distinct().withColumn("in_cycle", F.lit(True))
    lowest = open_.join(on_cycle, "tweet_id").select(F.col("tweet_id").alias("up"), F.col("least").alias("root"))
    looped = open_.select("tweet_id", "up").join(lowest, "up").join(on_cycle, "tweet_id", "left")
    return made.unionByName(
        looped.select("tweet_id", "root", F.lit(None).cast("long").alias("depth"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    )


def reply_depths(messages: DataFrame, parent: str = "in_response_to_tweet_id") -> DataFrame:
    """``(tweet_id, root, depth)`` of the messages that lead to a root."""
    return reply_chains(messages, parent).filter("depth is not null").select("tweet_id", "root", "depth")


def reply_cycles(messages: DataFrame, parent: str = "in_response_to_tweet_id") -> DataFrame:
    """``(tweet_id, root)`` of the messages on cycles; ``root`` is the cycle's least id."""
    return reply_chains(messages, parent).filter("in_cycle").select("tweet_id", "root")
