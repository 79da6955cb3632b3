"""Mining (context, response) samples from a reply graph, level by level.

Each level is one Spark job whose result is a Parquet folder ``depth=N``. The
folder cuts the lineage, gives the next join real sizes, and is the output: the
samples are a filter over all levels, so nothing is copied or unioned at the end.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.operators import gates
from threadloom.operators.reply_hop import (
    Fan,
    Rules,
    fan_metrics,
    in_parts,
    join_replies,
    links,
    replies_of,
)
from threadloom.session import fresh_path

LEVEL = T.StructType(
    [
        T.StructField("trail", T.StringType()),
        T.StructField("sender", T.ArrayType(T.StringType())),
        T.StructField("tweets", T.ArrayType(T.StringType())),
        T.StructField("response", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("self_response", T.BooleanType()),
        T.StructField("next", T.ArrayType(T.LongType())),
    ]
)

LEVELS = T.StructType([*LEVEL.fields, T.StructField("depth", T.IntegerType())])


# What a row's texts weigh, for sizing the next hop.
WIDTH = "64 + length(concat_ws('', tweets, response))"

# Take the reply into the context, merged when its author spoke last, and name
# the replies to it. ``if`` takes an unknown author for another one.
CHAINS = (
    "trail",
    "first_place",
    "posexplode(next) as (place, reply_id)",
    "if(self_response, sender, array_append(sender, author_id)) as sender",
    """if(self_response,
         concat(slice(tweets, 1, size(tweets) - 1),
                array(concat(element_at(tweets, -1), ' ', response))),
         array_append(tweets, response)) as tweets""",
)

HOP = (
    "md5(concat_ws(':', trail, tweet_id, first_place + place)) as trail",
    "sender",
    "tweets",
    "text as response",
    "author_id",
    "element_at(sender, -1) = author_id as self_response",
    "next",
)


def next_hops(level: DataFrame, replies: DataFrame, fan: Fan, rules: Rules = Rules()) -> DataFrame:
    chains = in_parts(level, fan, "trail").selectExpr(*CHAINS)
    return join_replies(chains, level, replies, fan, "trail", rules).selectExpr(*HOP)


def _roots_as_level(messages: DataFrame) -> DataFrame:
    """Roots as replies to nothing: the first hop takes them into empty contexts."""
    return gates.roots(messages).select(
        F.expr("md5(coalesce(cast(tweet_id as string), ''))").alias("trail"),
        F.expr("cast(array() as array<string>)").alias("sender"),
        F.expr("cast(array() as array<string>)").alias("tweets"),
        F.col("text").alias("response"),
        "author_id",
        F.lit(False).alias("self_response"),
        links().alias("next"),
    )


def mine_levels(
    messages: DataFrame,
    max_depth: int = V.MAX_DEPTH,
    gate_english: bool = True,
    path: str | None = None,
    rules: Rules = Rules(),
    warn: bool = True,
) -> DataFrame:
    """Walk every reply path from every root; one row per hop, with its depth.

    The gate drops messages before the walk, so a rejected message also cuts
    what hangs below it. Paths are a bag: a reply reached twice counts twice.
    ``path`` keeps the levels there; otherwise they go to the shared folder.
    Chains that the bound ends are warned of (``reply_chains`` tells long chains
    from cycles), unless ``warn`` is False.
    """
    spark = messages.sparkSession
    if max_depth < 1:
        return spark.createDataFrame([], LEVELS)
    path = path or fresh_path(spark, "mined")
    if gate_english:
        messages = messages.filter(X.is_english("text"))
    cut = 0
    with replies_of(messages, ["author_id", "text"], rules) as replies:
        level = _roots_as_level(messages)
        sizes = fan_metrics(WIDTH)
        fan = Fan.of(level.agg(*sizes).first())
        for depth in range(max_depth):
            folder = f"{path}/depth={depth}"
            seen = Observation()
            hops = next_hops(level, replies, fan, rules)
            hops.observe(seen, *sizes).write.parquet(folder)
            found = seen.get
            cut = found["open"]
            if not cut:
                break
            fan = Fan.of(found)
            level = spark.read.schema(LEVEL).parquet(folder)
    if cut and max_depth > 1 and warn:
        warnings.warn(f"{cut} chains go on below the depth bound of {max_depth}", stacklevel=2)
    return spark.read.schema(LEVELS).parquet(path)


def samples_of(levels: DataFrame) -> DataFrame:
    """Hops to another author. A NULL author on either side gives no sample."""
    return levels.filter(~F.col("self_response")).select(
        F.col("trail").alias("id"), "sender", "tweets", "response", "author_id"
    )


def progress_of(levels: DataFrame) -> DataFrame:
    """Per depth: chains still open, and samples found so far."""
    per_depth = levels.groupBy("depth").agg(
        F.count_if(F.col("next").isNotNull()).alias("chains"),
        F.count_if(~F.col("self_response")).alias("found"),
    )
    # One row per depth, so at most ``max_depth`` rows reach this window.
    so_far = F.sum("found").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    return per_depth.select("depth", "chains", so_far.alias("samples"))


def cut_by_depth(levels: DataFrame, max_depth: int = V.MAX_DEPTH) -> DataFrame:
    """How many chains were still open when the depth bound ended the walk."""
    return levels.filter((F.col("depth") == max_depth - 1) & F.col("next").isNotNull()).agg(
        F.count("*").alias("chains_cut")
    )


def mine(
    messages: DataFrame,
    max_depth: int = V.MAX_DEPTH,
    gate_english: bool = True,
    path: str | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """Samples ``(id, sender, tweets, response, author_id)`` of a message table."""
    return samples_of(mine_levels(messages, max_depth, gate_english, path, rules))
