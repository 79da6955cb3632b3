"""The join every walk repeats: open chains with the replies they name.

Replies are partitioned by message id once and cached, so a hop shuffles only
the chains. How the chains move is decided per hop from counted sizes: a small
frontier is broadcast; otherwise chains are shuffled by reply id, and reply ids
named by very many chains go through a salted join of their own. A message with
a very long reply list is cut into parts that unfold in different tasks.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch, parallelism

BROADCAST_BYTES = 8 * 1024 * 1024
HOT_CHECK_ROWS = 1_000_000
HOT_CHECK_BYTES = 256 * 1024 * 1024
LIST_PART = 100_000
#: Bytes of replies in a bucket of a stored table.
BUCKET_BYTES = 64 * 1024 * 1024
_SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class Rules:
    """When chains are broadcast, and from which size on busy reply ids are looked for.

    None is the module's own bound. ``store`` keeps the replies as a bucketed table
    instead of in executors' memory.
    """

    broadcast_bytes: int | None = None
    hot_rows: int | None = None
    hot_bytes: int | None = None
    store: bool = False


@dataclass(frozen=True)
class Fan:
    """Size of a frontier after its reply lists are unfolded."""

    rows: int
    bytes: int
    longest: int

    @classmethod
    def of(cls, metrics) -> Fan:
        return cls(metrics["fan_rows"], metrics["fan_bytes"], metrics["longest"])


def fan_metrics(width: str) -> list[Column]:
    """Aggregates that size a frontier; ``width`` is a row's size as SQL."""
    fan = "cast(if(next is null, 0, size(next)) as bigint)"
    return [
        F.expr("count_if(next is not null)").alias("open"),
        F.expr(f"coalesce(sum({fan}), 0)").alias("fan_rows"),
        F.expr(f"coalesce(sum({fan} * ({width})), 0)").alias("fan_bytes"),
        F.expr(f"coalesce(max({fan}), 0)").alias("longest"),
    ]


def links(column: str = "response_tweet_id") -> Column:
    """The comma list of reply ids as numbers."""
    return F.expr(f"transform(split({column}, ','), piece -> try_cast(piece as bigint))")


def reply_table(messages: DataFrame, columns: list[str]) -> DataFrame:
    """Messages ready to be joined as replies: partitioned and sorted by id, cached.

    ``tweet_id`` is the table's key; rows without one can never be a reply.
    """
    table = messages.filter("tweet_id is not null").select(
        "tweet_id", *columns, links().alias("next")
    )
    partitions = parallelism(messages.sparkSession)
    placed = table.repartition(partitions, "tweet_id").sortWithinPartitions("tweet_id")
    return placed.persist(StorageLevel.MEMORY_AND_DISK)


@contextlib.contextmanager
def reply_store(messages: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """The reply table as Parquet buckets by message id, each one sorted file, for the time of the block.

    Buckets are as many as the counted bytes need. A hop then shuffles and sorts the
    chains only: the plan has neither an exchange nor a sort on the side of the
    replies, and a lost executor takes none of them along.
    """
    spark = messages.sparkSession
    table = messages.filter("tweet_id is not null").select("tweet_id", *columns, links().alias("next"))
    width = F.expr(f"48 + coalesce(length(concat_ws('', {', '.join(columns)})), 0) + 8 * coalesce(size(next), 0)")
    size = table.agg(F.sum(width.cast("long"))).first()[0] or 0
    buckets = max(parallelism(spark), -(-size // BUCKET_BYTES))
    tables, name = Scratch(spark, "replies"), f"replies_{uuid.uuid4().hex}"
    path, before = tables.path("buckets"), spark.conf.get(_SORTED_BUCKETS)
    writer = table.repartition(buckets, "tweet_id").write.format("parquet").option("path", path)
    writer.bucketBy(buckets, "tweet_id").sortBy("tweet_id").saveAsTable(name)
    # scans of one sorted file per bucket keep its order only under this setting
    spark.conf.set(_SORTED_BUCKETS, "true")
    try:
        yield spark.table(name)
    finally:
        spark.conf.set(_SORTED_BUCKETS, before)
        spark.sql(f"drop table if exists {name}")
        tables.remove()


@contextlib.contextmanager
def replies_of(messages: DataFrame, columns: list[str], rules: Rules) -> Iterator[DataFrame]:
    """Replies for the time of a walk: cached, or stored."""
    if rules.store:
        with reply_store(messages, columns) as replies:
            yield replies
        return
    replies = reply_table(messages, columns)
    try:
        yield replies
    finally:
        replies.unpersist()


def in_parts(level: DataFrame, fan: Fan, spread_by: str) -> DataFrame:
    """The level with ``first_place``, the place of the first id of ``next``.

    Reply lists longer than a part become several rows, spread over the tasks.
    """
    if fan.longest <= LIST_PART:
        return level.withColumn("first_place", F.lit(0))
    others = [c for c in level.columns if c != "next"]
    parts = (
        f"transform(sequence(0, (size(next) - 1) div {LIST_PART}),"
        f" p -> slice(next, cast(p * {LIST_PART} as int) + 1, {LIST_PART}))"
    )
    cut = level.filter("size(next) > 0").selectExpr(*others, f"posexplode({parts}) as (part, next)")
    spread = cut.repartition(parallelism(level.sparkSession), spread_by, "part")
    return spread.withColumn("first_place", F.expr(f"part * {LIST_PART}")).drop("part")


def _bound(own: int | None, default: int) -> int:
    return default if own is None else own


def hot_reply_ids(level: DataFrame, fan: Fan, rules: Rules = Rules()) -> list[int]:
    """Reply ids named by more than a quarter of an average partition.

    Fewer than ``4 * partitions`` ids can pass, whatever the data. Only frontiers
    of many rows or many bytes are counted.
    """
    if fan.rows < _bound(rules.hot_rows, HOT_CHECK_ROWS) and fan.bytes < _bound(rules.hot_bytes, HOT_CHECK_BYTES):
        return []
    bar = max(1, fan.rows // (4 * parallelism(level.sparkSession)))
    named = level.select(F.explode("next").alias("reply_id"))
    counts = named.groupBy("reply_id").count().filter(
        f"count > {bar} and reply_id is not null"
    )
    return [r.reply_id for r in counts.select("reply_id").collect()]


def is_broadcast(fan: Fan, rules: Rules = Rules()) -> bool:
    return fan.bytes <= _bound(rules.broadcast_bytes, BROADCAST_BYTES)


def join_replies(
    chains: DataFrame,
    level: DataFrame,
    replies: DataFrame,
    fan: Fan,
    spread_by: str,
    rules: Rules = Rules(),
    hot: list[int] | None = None,
) -> DataFrame:
    """Inner join of the chains grown from ``level`` with the replies they name.

    ``spread_by`` is the chain column by which a hot reply id is salted, ``hot`` the
    busy reply ids where these are known. The
    reply table is joined as a DataFrame, because the cache is found that way.
    """
    match = F.col("reply_id") == F.col("tweet_id")
    if is_broadcast(fan, rules):
        return chains.hint("broadcast").join(replies, match)
    hot = hot_reply_ids(level, fan, rules) if hot is None else hot
    if not hot:
        return chains.hint("merge").join(replies, match)

    lanes = parallelism(level.sparkSession)
    is_hot = F.col("reply_id").isin(hot)
    cold = chains.filter(~is_hot).hint("merge").join(replies, match)
    salted = chains.filter(is_hot).withColumn("lane", F.expr(f"pmod(xxhash64({spread_by}), {lanes})"))
    copies = replies.filter(F.col("tweet_id").isin(hot)).selectExpr(
        "*", f"explode(sequence(0L, {lanes - 1}L)) as copy"
    )
    busy = salted.hint("merge").join(copies, match & (F.col("lane") == F.col("copy")))
    return cold.unionByName(busy.drop("lane", "copy"))
