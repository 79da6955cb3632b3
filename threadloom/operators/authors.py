"""Author dictionary and speaker classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import arrays as A
from threadloom.session import at_most, broadcast_if_small, materialize

INLINE_ACCOUNTS = 5_000
PATTERN_ACCOUNTS = 1_000_000


def distinct_authors(messages: DataFrame) -> DataFrame:
    return messages.select("author_id").distinct()


def encode_authors(rows: DataFrame, authors: DataFrame, column: str = "author_id") -> DataFrame:
    """Add ``author_code``: the dictionary's code, 0 for an unknown author.

    A name listed twice has its last code, as in ``read_authors``.
    """
    codes = broadcast_if_small(
        authors.groupBy(F.col("author_id").alias(column)).agg(F.max("code").alias("author_code"))
    )
    joined = rows.join(codes, column, "left")
    return joined.withColumn("author_code", F.coalesce("author_code", F.lit(0)))


def account_names(authors: DataFrame, limit: int = PATTERN_ACCOUNTS) -> list[str]:
    """The dictionary's names in code order, for patterns and short lists.

    They are held by the driver and sent with every task that cleans texts, so
    their number is checked: more than ``limit`` (some 20 MB of names) are an error.
    """
    if not at_most(authors, limit):
        raise ValueError(f"more than {limit} accounts")
    return [r.author_id for r in authors.select("author_id", "code").orderBy("code").collect()]


def _class_if_listed(name: Column, accounts: list[str]) -> Column:
    known = name.isin(accounts) if accounts else F.lit(False)
    return A.speaker_class(F.coalesce(known, F.lit(False)).cast("int"))


def speaker_classes(
    samples: DataFrame, authors: DataFrame, inline: int = INLINE_ACCOUNTS
) -> DataFrame:
    """Add ``sender_class`` per turn and ``author_class``: 2 account, 1 customer.

    A dictionary of up to ``inline`` names is compared in place, without moving
    the samples. Otherwise the turns are unfolded, joined, and regrouped by a
    number given to each row, so both ways treat empty and missing senders, repeated
    samples and repeated names alike.
    """
    if at_most(authors, inline):
        accounts = account_names(authors, inline)
        return samples.withColumns(
            {
                "sender_class": F.transform("sender", lambda s: _class_if_listed(s, accounts)),
                "author_class": _class_if_listed(F.col("author_id"), accounts),
            }
        )
    # written once, so that both readings see the same row numbers
    numbered = materialize(
        samples.select(F.struct("*").alias("sample"), F.monotonically_increasing_id().alias("row")),
        "numbered-samples",
    )
    turns = numbered.select("row", F.posexplode("sample.sender").alias("pos", "author_id"))
    coded = encode_authors(turns, authors).select(
        "row", "pos", A.speaker_class("author_code").alias("cls")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "cls")))
    grouped = coded.groupBy("row").agg(F.transform(ordered, lambda p: p["cls"]).alias("classes"))
    named = numbered.select("row", "sample", F.col("sample.author_id").alias("author_id"))
    none = F.array().cast("array<int>")
    sender_class = F.when(F.col("sample.sender").isNotNull(), F.coalesce("classes", none))
    return (
        encode_authors(named, authors)
        .join(grouped, "row", "left")
        .select(
            "sample.*",
            sender_class.alias("sender_class"),
            A.speaker_class("author_code").alias("author_class"),
        )
    )
