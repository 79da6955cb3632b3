"""Rollups of training metrics and weighted losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import vectors as L


def metric_rollup(
    steps: DataFrame, every: int = V.LOG_EVERY, values: tuple[str, ...] = ("loss", "all_loss")
) -> DataFrame:
    """Means between reports, which come at step 0 and then every ``every`` steps.

    ``steps`` is ``(epoch, step, *values)`` with steps counted per epoch. Steps
    after the last report form a group of their own, marked as not reported.
    """
    group = F.ceil(F.col("step") / F.lit(float(every))).alias("report")
    means = [F.avg(v).alias(v) for v in values]
    rolled = steps.groupBy("epoch", group).agg(
        F.count("*").alias("steps"), F.max("step").alias("last_step"), *means
    )
    return rolled.withColumn("reported", F.col("last_step") == F.col("report") * every)


def evaluation_means(
    steps: DataFrame, values: tuple[str, ...] = ("loss", "all_loss")
) -> DataFrame:
    """Mean of the evaluation steps of each epoch, apart from training steps."""
    return steps.groupBy("epoch").agg(*[F.avg(v).alias(v) for v in values])


def cross_entropy(logits: str = "logits", target: str = "target"):
    """Negative log-likelihood of the target class under the softmax of the logits."""
    return L.log_sum_exp(logits) - F.element_at(logits, F.col(target) + 1).cast("double")


def weighted_cross_entropy(
    rows: DataFrame, logits: str = "logits", target: str = "target", weight: str = "weight"
) -> DataFrame:
    """``loss`` divides the weighted sum by the rows, ``metric`` by the weights."""
    weighted = rows.select(
        (F.col(weight).cast("double") * cross_entropy(logits, target)).alias("wce"),
        F.col(weight).cast("double").alias("w"),
    )
    return weighted.agg(
        (F.sum("wce") / F.count("*")).alias("loss"),
        F.try_divide(F.sum("wce"), F.sum("w")).alias("metric"),
    )
