"""A bounded, repeatable sample of labelled rows, and where labels may be learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def in_fold(doc_id: Column, divisor: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == fold, F.lit(False))


def training_labels(labels: DataFrame, label: str, divisor: int, fold: int) -> DataFrame:
    """One (doc_id, label) row per document that may be learned from.

    Null ids and labels are left out; of contradicting labels the larger wins.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~in_fold(F.col("doc_id"), divisor, fold))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, divisor: int, fold: int, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """Whole texts of at most ``per_class`` rows of each label, and the label counts.

    The rows taken are those of the smallest hashes of their ids, so the sample
    depends neither on order nor on partitions. Its ids are few by
    ``per_class``, so they are broadcast to the scan of the texts.
    """
    known = training_labels(labels, label, divisor, fold).join(
        docs.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    taken = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    return rows, counts
