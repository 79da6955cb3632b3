"""Turning id paths back into texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X


def _turn_text(parts, place, whole):
    """Texts of one turn joined in order; NULL if no message, or with ``whole`` not each, was found."""
    own = F.filter(parts, lambda p: p["place"] == place)
    found = F.filter(own, lambda p: p["text"].isNotNull())
    joined = F.array_join(F.transform(found, lambda p: p["text"]), " ")
    return F.when(F.size(found) == F.size(own) if whole else F.size(found) > 0, joined)


def rehydrate(
    paths: DataFrame,
    messages: DataFrame,
    words_above: int | None = V.MIN_WORDS,
    whole_turns: bool = False,
) -> DataFrame:
    """Samples with texts from paths ``(id, sender, context, response, author_id)``.

    A turn of which no message has a text is NULL, with ``whole_turns`` also one
    of which some message has none, as in mining with texts. A sample whose
    response is missing or has too few words is dropped; with ``words_above`` None
    all samples stay. Context and response
    ids go through one join and one regrouping by ``id``, which must be unique;
    a message named by very many paths makes a skewed join partition, which
    adaptive execution splits.
    """
    # The response row also carries what is known per sample, so that one
    # regrouping yields the whole sample and paths are not joined again.
    turns = paths.select("id", F.posexplode("context").alias("place", "ids")).select(
        "id", "place", F.posexplode("ids").alias("step", "tweet_id")
    )
    answers = paths.select(
        "id",
        F.lit(-1).alias("place"),
        F.lit(0).alias("step"),
        F.col("response").alias("tweet_id"),
        "sender",
        "author_id",
    )
    texts = messages.select("tweet_id", "text")
    found = turns.unionByName(answers, allowMissingColumns=True).join(texts, "tweet_id", "left")
    samples = found.groupBy("id").agg(
        F.first("sender", ignorenulls=True).alias("sender"),
        F.first("author_id", ignorenulls=True).alias("author_id"),
        F.array_sort(F.collect_list(F.struct("place", "step", "text"))).alias("parts"),
    )
    turn_places = F.sequence(F.lit(0), F.size("sender") - 1)
    filled = samples.select(
        "id",
        "sender",
        F.transform(turn_places, lambda i: _turn_text(F.col("parts"), i, whole_turns)).alias("tweets"),
        _turn_text(F.col("parts"), F.lit(-1), True).alias("response"),
        "author_id",
    )
    if words_above is None:
        return filled
    return filled.filter(X.word_count("response") > words_above)


def turn_rows(paths: DataFrame) -> DataFrame:
    """One row per turn of flat paths: position, sender and message id zipped."""
    zipped = F.arrays_zip("sender", "context")
    return paths.select("id", F.posexplode(zipped).alias("pos", "turn")).select(
        "id", "pos", F.col("turn.sender").alias("sender"), F.col("turn.context").alias("tweet_id")
    )


def context_texts(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Left lookup of each turn's text; unmatched turns keep a NULL text."""
    return turn_rows(paths).join(messages.select("tweet_id", "text"), "tweet_id", "left")


def response_texts(
    paths: DataFrame, messages: DataFrame, words_above: int = V.MIN_WORDS
) -> DataFrame:
    """Response text per path; only found texts with enough words remain."""
    texts = messages.select(
        F.col("tweet_id").alias("response"), "text", X.word_count("text").alias("wordcount")
    )
    return (
        paths.select("id", "response", "author_id")
        .join(texts, "response", "inner")
        .filter(F.col("wordcount") > words_above)
    )


def by_context_length(paths: DataFrame) -> DataFrame:
    """Longest contexts first; the id breaks ties."""
    return paths.withColumn("length", F.size("sender")).orderBy(F.desc("length"), "id")
