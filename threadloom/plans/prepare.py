"""From messages to packed training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import text as X
from threadloom.operators.authors import account_names, speaker_classes
from threadloom.operators.mining import mine
from threadloom.operators.packing import assign_split, coded_turns, encode_by_id, encode_by_shelf, pack_encoded
from threadloom.operators.rehydrate import rehydrate
from threadloom.operators.subwords import TurnEncoder, learn_subwords
from threadloom.session import at_most, broadcast_if_small, materialize


def mine_by_ids(
    messages: DataFrame, max_depth: int = V.MAX_DEPTH, gate_english: bool = True
) -> DataFrame:
    """The samples of ``mine``, with texts left out of the walk.

    For wide texts: the walk carries message ids, joined with blanks where
    turns merge, and the texts are attached once at the end. A message
    without a text makes its turn NULL either way. Message ids must be unique.
    """
    if gate_english:
        messages = messages.filter(X.is_english("text"))
    named = messages.withColumn("text", F.col("tweet_id").cast("string"))
    walked = mine(named, max_depth, gate_english=False)
    paths = walked.select(
        "id",
        "sender",
        F.expr("transform(tweets, t -> cast(split(t, ' ') as array<bigint>))").alias("context"),
        F.col("response").cast("bigint").alias("response"),
        "author_id",
    )
    return rehydrate(paths, messages, words_above=None, whole_turns=True)


@dataclass(frozen=True)
class Prepared:
    """Packed rows with their split, and the vocabulary they were encoded with."""

    rows: DataFrame
    vocabulary: DataFrame
    merges: DataFrame


def clean_corpus(
    messages: DataFrame, accounts: list[str], signature: str = "loose", gate_english: bool = True
) -> DataFrame:
    """English messages cleaned as the text the vocabulary is learned from."""
    if gate_english:
        messages = messages.filter(X.is_english("text"))
    return messages.select(X.clean_text("text", accounts, signature).alias("text"))


def _packed(
    samples: DataFrame, encoder: TurnEncoder, authors: DataFrame, accounts: list[str], signature: str, length: int
) -> DataFrame:
    """Samples packed with each distinct turn encoded once; those whose id repeats get their turns by id."""
    coded = coded_turns(samples, encoder, accounts, signature)
    repeated = materialize(samples.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    if at_most(repeated, 0):
        made = encode_by_shelf(samples, coded)
    else:
        ids = broadcast_if_small(repeated)
        others = encode_by_id(samples.join(ids, "id", "left_semi"), coded)
        made = encode_by_shelf(samples.join(ids, "id", "left_anti"), coded).unionByName(others)
    return pack_encoded(speaker_classes(made, authors), length)


def prepare(
    messages: DataFrame,
    authors: DataFrame,
    vocab_size: int = V.SUBWORD_VOCABULARY_SIZE,
    max_depth: int = V.MAX_DEPTH,
    path: str | None = None,
    merges: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    signature: str = "strict",
    gate_english: bool = True,
    phone_id: str = "unknown",
    rate: float = V.TEST_RATE,
    length: int = V.SEQUENCE_LENGTH,
) -> Prepared:
    """Mine, learn a vocabulary, pack, and split; reruns give the same rows.

    Given ``merges`` and their base ``vocabulary`` nothing is learned. Turns are
    encoded once each, not once per sample, and brought to shelves of samples.
    """
    accounts = account_names(authors)
    if (merges is None) != (vocabulary is None):
        raise ValueError("give merges and vocabulary together")
    if merges is None:
        merges, vocabulary = learn_subwords(clean_corpus(messages, accounts, gate_english=gate_english), "text", vocab_size)
    samples = mine(messages, max_depth, gate_english, path=path)
    encoder = TurnEncoder(merges, vocabulary, phone_id)
    rows = _packed(samples, encoder, authors, accounts, signature, length)
    return Prepared(assign_split(rows, rate=rate), vocabulary, merges)


def samples_by_split(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))
