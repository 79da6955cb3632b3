"""Row filters: language, validity, roots, account discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X


def fill_none(
    messages: DataFrame, columns=("response_tweet_id", "in_response_to_tweet_id")
) -> DataFrame:
    """Export form of missing links: the word ``none`` instead of NULL."""
    return messages.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns}
    )


def keep_english(
    messages: DataFrame, column: str = "text", threshold: float = V.ENGLISH_SHARE
) -> DataFrame:
    return messages.filter(X.is_english(column, threshold))


def reject_spanish(messages: DataFrame, column: str = "text") -> DataFrame:
    return messages.filter(~X.has_spanish(column))


def reject_empty(messages: DataFrame, column: str = "text") -> DataFrame:
    return messages.filter(~X.is_empty(column))


def roots(messages: DataFrame) -> DataFrame:
    """Conversation starts: not a reply, and replied to."""
    return messages.filter(
        F.col("in_response_to_tweet_id").isNull() & F.col("response_tweet_id").isNotNull()
    )


def still_open(chains: DataFrame, link: str = "response_tweet_id") -> DataFrame:
    return chains.filter(F.col(link).isNotNull())


def not_self_response(hops: DataFrame, last_sender: Column, author: str = "author_id") -> DataFrame:
    """Keep replies by somebody else; an unknown author on either side drops the row."""
    return hops.filter(last_sender != F.col(author))


def min_words(messages: DataFrame, above: int = V.MIN_WORDS, column: str = "text") -> DataFrame:
    """Keep texts with more than ``above`` blank-separated pieces."""
    return messages.withColumn("wordcount", X.word_count(column)).filter(F.col("wordcount") > above)


def discover_accounts(messages: DataFrame) -> DataFrame:
    """Authors of outbound messages whose name holds no digit."""
    return (
        messages.filter(~F.col("inbound"))
        .select("author_id")
        .distinct()
        .filter(F.col("author_id").rlike("^[^0-9]*$"))
    )


def reject_reason(turns: Column | str, response: Column | str) -> Column:
    """Why the gates reject a sample; NULL when they do not."""
    turns, response = X._col(turns), X._col(response)
    return (
        F.when(F.exists(turns, lambda t: F.coalesce(X.is_empty(t), F.lit(True))), "empty turn")
        .when(F.exists(turns, X.has_spanish), "spanish turn")
        .when(F.coalesce(X.is_empty(response), F.lit(True)), "empty response")
        .when(X.has_spanish(response), "spanish response")
    )
