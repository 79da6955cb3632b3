"""Counts and reports over messages and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def length_histogram(samples: DataFrame) -> DataFrame:
    """Samples per context length, with the count's decimal logarithm."""
    return (
        samples.groupBy(F.size("tweets").alias("length"))
        .agg(F.count("*").alias("n"))
        .withColumn("log_n", F.log10("n"))
        .orderBy("length")
    )


def char_frequency(messages: DataFrame, column: str = "text") -> DataFrame:
    """Characters by how often they occur, most frequent first."""
    return (
        messages.select(F.explode(F.split(column, "")).alias("character"))
        .groupBy("character")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "character")
    )


def top_rows(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows for inspection, largest ``by`` first, then by key."""
    return rows.orderBy(F.desc(by), key).limit(n)
