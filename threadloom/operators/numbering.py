"""Exact positions in a global order, and what needs them: batch feeds and folds of ordered groups.

Rows are dealt by range of their order and sorted in their task, so a row's position
is its place in its partition and the number of rows in the partitions before. Only
those counts, one per partition, reach the driver. No window sees the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.operators.packing import order_digest
from threadloom.session import Scratch, parallelism

#: Entries of a group's list that one row holds.
PART = 10_000
_IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], tables: Scratch | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``place``, from 0, by ``order``; rows equal in ``order`` take any order among them.

    The sorted rows are written once, so places stay the same however often they are read.
    """
    tables = tables or Scratch(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(partitions or parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    written = tables.table(dealt.withColumn("_mono", F.monotonically_increasing_id()), "sorted")
    partition, row = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit(_IN_PARTITION))
    counts = written.groupBy(partition.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before))
        before += r["n"]
    # a row per partition
    starts = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    placed = written.withColumn("_part", partition).join(F.broadcast(starts), "_part")
    return placed.withColumn("place", F.col("_before") + row).drop("_part", "_before", "_mono")


def global_feed(
    rows: DataFrame,
    key: str = "id",
    batch_size: int = V.BATCH_SIZE,
    seed: int = V.SPLIT_SEED,
    epoch: int = 0,
    start_batch: int = 0,
) -> DataFrame:
    """Rows with ``batch_no`` and ``slot`` in one repeatable random order of the whole table.

    All batches but the last are full. ``start_batch`` resumes a feed: the batches
    from there on, the same as in the whole feed. ``key`` is unique.
    """
    drawn = rows.withColumn("_digest", order_digest(seed, F.lit(epoch), key))
    placed = numbered(drawn, ["_digest", key]).filter(F.col("place") >= start_batch * batch_size)
    return placed.select(
        *rows.columns,
        F.floor(F.col("place") / batch_size).alias("batch_no"),
        (F.col("place") % batch_size).alias("slot"),
    )


def feed_epochs(rows: DataFrame, epochs: int, key: str = "id", batch_size: int = V.BATCH_SIZE, seed: int = V.SPLIT_SEED) -> DataFrame:
    """The feeds of some epochs, each in its own order, with ``epoch``."""
    made = [global_feed(rows, key, batch_size, seed, e).withColumn("epoch", F.lit(e)) for e in range(epochs)]
    whole = made[0]
    for feed in made[1:]:
        whole = whole.unionByName(feed)
    return whole


def indexed(rows: DataFrame, keys: list[str], order: list[str], part: int = PART, tables: Scratch | None = None) -> DataFrame:
    """Add each row's ``index`` in its group, from 0, and its ``part``, ``part`` rows each.

    A group of any size is sorted over as many tasks as its rows need.
    """
    placed = numbered(rows, [*keys, *order], tables)
    first = placed.groupBy(*keys).agg(F.min("place").alias("_first"))
    left, right = placed.alias("l"), first.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    index = F.col("l.place") - F.col("r._first")
    joined = left.join(right, same).select("l.*", index.alias("index"))
    return joined.withColumn("part", F.floor(F.col("index") / part)).drop("place")


def list_parts(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str], part: int = PART
) -> DataFrame:
    """``(*keys, part, *values)``: each group's values in order, cut into lists of ``part`` entries.

    A row's running list is the parts before its own and the first ``index`` modulo
    ``part`` plus 1 entries of its own part; see ``indexed``.
    """
    placed = indexed(rows, keys, order, part)
    ordered = F.array_sort(F.collect_list(F.struct("index", *values)))
    held = placed.groupBy(*keys, "part").agg(ordered.alias("_held"))
    lists = [F.col("_held").getField(v).alias(v) for v in values]
    return held.select(*keys, "part", *lists)


def merged_parts(
    fans: DataFrame,
    keys: tuple[str, ...] = ("context", "author_id", "next"),
    order: str = "rpos",
    message: str = "tweet_id",
    text: str = "text",
    part: int = PART,
) -> DataFrame:
    """Groups of messages merged as by ``merge_fans``, in parts of bounded size.

    A group's merged turn is its parts' texts in order, joined by a blank. Groups
    may hold any number of messages.
    """
    parts = list_parts(fans, list(keys), [order, message], [order, message, text], part)
    return parts.select(
        *keys,
        "part",
        F.element_at(order, 1).alias(order),
        F.col(message).alias("tweet_ids"),
        F.array_join(F.col(text), " ").alias("text"),
    )
