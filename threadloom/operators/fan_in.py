"""Walks that merge several messages of one author answered by the same reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.operators import gates
from threadloom.operators.reply_hop import (
    Fan,
    Rules,
    fan_metrics,
    hot_reply_ids,
    in_parts,
    is_broadcast,
    join_replies,
    links,
    reply_table,
)
from threadloom.session import fresh_path, parallelism

PATH_LEVEL = T.StructType(
    [
        T.StructField("sender", T.ArrayType(T.StringType())),
        T.StructField("context", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("place", T.IntegerType()),
        T.StructField("response", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("next", T.ArrayType(T.LongType())),
    ]
)
PATH_LEVELS = T.StructType([*PATH_LEVEL.fields, T.StructField("depth", T.IntegerType())])


def in_order(*fields: str) -> Column:
    """The group's rows as structs, ordered by the fields from left to right."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def merge_fans(
    fans: DataFrame,
    keys: tuple[str, ...] = ("context", "author_id", "next"),
    order: str = "rpos",
    message: str = "tweet_id",
    text: str = "text",
) -> DataFrame:
    """One row per group of messages that share context, author and reply.

    The messages are merged in reply order, message ids breaking ties. The
    result of a group is one row that holds them all, so a group can be no
    larger than a row.
    """
    parts = fans.groupBy(*keys).agg(in_order(order, message, text).alias("parts"))
    return parts.select(
        *keys,
        F.element_at("parts", 1)[order].alias(order),
        F.transform("parts", lambda p: p[message]).alias("tweet_ids"),
        F.array_join(F.transform("parts", lambda p: p[text]), " ").alias("text"),
    )


def running_list(value: str, partition_by: list[str], order_by: list[str]) -> Column:
    """``collect_list`` over an ordered window: every row sees its own prefix."""
    return F.collect_list(value).over(Window.partitionBy(*partition_by).orderBy(*order_by))


def running_first(value: str, partition_by: list[str], order_by: list[str]) -> Column:
    return F.first(value).over(Window.partitionBy(*partition_by).orderBy(*order_by))


WIDTH = "64 + aggregate(context, 0, (n, ids) -> n + 16 + 8 * size(ids))"

FRONT = (
    "context",
    "sender",
    "author_id",
    "place",
    "response",
    "first_place",
    "posexplode(next) as (onward, reply_id)",
)
# Messages of one author in one context that name the same reply become one
# turn, in the order in which they were replies themselves.
PARTS = """array_sort(collect_list(
  named_struct('place', place, 'response', response, 'onward', first_place + onward)))"""
CHAINS = (
    "reply_id",
    "array_append(sender, author_id) as sender",
    "array_append(context, transform(parts, p -> p.response)) as context",
    "parts[0].onward as place",
)
HOP = ("sender", "context", "place", "tweet_id as response", "author_id", "next")


# What tells groups of one reply and author apart, as 128 bits: arrays are slow keys.
PATH_KEYS = {
    "path_1": "xxhash64(to_json(struct(context, sender)))",
    "path_2": "xxhash64(1, to_json(struct(context, sender)))",
}


def next_hops(level: DataFrame, replies: DataFrame, fan: Fan, rules: Rules = Rules()) -> DataFrame:
    """One hop. Fronts move once, to their reply, where they are merged and joined; with
    busy reply ids they are merged where their path takes them, and move again."""
    keyed = in_parts(level, fan, "response").withColumns({k: F.expr(v) for k, v in PATH_KEYS.items()})
    fronts = keyed.selectExpr(*PATH_KEYS, *FRONT)
    hot = None
    if not is_broadcast(fan, rules):
        hot = hot_reply_ids(level, fan, rules)
        if not hot:
            fronts = fronts.repartition(parallelism(level.sparkSession), "reply_id")
    groups = fronts.groupBy(*PATH_KEYS, "author_id", "reply_id")
    merged = groups.agg(F.first("context").alias("context"), F.first("sender").alias("sender"), F.expr(PARTS).alias("parts"))
    return join_replies(merged.selectExpr(*CHAINS), level, replies, fan, "context", rules, hot).selectExpr(*HOP)


def _roots_as_level(messages: DataFrame) -> DataFrame:
    return gates.roots(messages).select(
        F.expr("cast(array() as array<string>)").alias("sender"),
        F.expr("cast(array() as array<array<bigint>>)").alias("context"),
        F.lit(1).alias("place"),
        F.col("tweet_id").alias("response"),
        "author_id",
        links().alias("next"),
    )


def mine_fan_in(
    messages: DataFrame,
    max_depth: int = V.MAX_DEPTH,
    gate_english: bool = True,
    path: str | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """Id paths ``(id, sender, context, response, author_id)`` of every hop.

    ``context`` holds one array of message ids per turn, so merged turns stay
    aligned with ``sender``. Replies by the last sender are kept.
    """
    spark = messages.sparkSession
    path = path or fresh_path(spark, "paths")
    if gate_english:
        messages = messages.filter(X.is_english("text"))
    replies = reply_table(messages, ["author_id"])
    try:
        level = _roots_as_level(messages)
        sizes = fan_metrics(WIDTH)
        fan = Fan.of(level.agg(*sizes).first())
        for depth in range(max_depth):
            folder = f"{path}/depth={depth}"
            seen = Observation()
            hops = next_hops(level, replies, fan, rules)
            hops.observe(seen, *sizes).write.parquet(folder)
            found = seen.get
            if not found["open"]:
                break
            fan = Fan.of(found)
            level = spark.read.schema(PATH_LEVEL).parquet(folder)
    finally:
        replies.unpersist()
    levels = spark.read.schema(PATH_LEVELS).parquet(path)
    key = F.md5(F.concat_ws("|", F.to_json("context"), F.col("response")))
    return levels.select(key.alias("id"), "sender", "context", "response", "author_id")
