"""Context-response scores, triplets and response selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import vectors as L
from threadloom.session import at_most, broadcast_if_small, materialize

CONTEXT_VALUES = 4_000_000
CONTEXT_BLOCK = 2_048
RESPONSE_BLOCK = 8_192
STRIP = 256
LANE_ROWS = 1_024


def _laned(contexts: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with lanes that split batches larger than usual on either side.

    A context goes to one of its batch's context lanes and to all its response
    lanes, a response the other way round; usual batches have one of each.
    """
    sides = contexts.select("batch_id", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(
        responses.select("batch_id", F.lit(0).alias("c"), F.lit(1).alias("r"))
    )
    sizes = sides.groupBy("batch_id").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    lanes = [F.greatest(F.ceil(F.col(x) / LANE_ROWS), F.lit(1)).alias(f"{x}_lanes") for x in "cr"]
    large = materialize(
        sizes.filter((F.col("c") > LANE_ROWS) | (F.col("r") > LANE_ROWS)).select("batch_id", *lanes),
        "large-batches",
    )
    if large.isEmpty():
        one = [F.lit(0).cast("long").alias(f"{x}_lane") for x in "cr"]
        return contexts.select("*", *one), responses.select("*", *one)
    large = broadcast_if_small(large)

    def spread(side: DataFrame, own: str, other: str, slot: str) -> DataFrame:
        of_own = F.pmod(F.xxhash64(slot), F.coalesce(f"{own}_lanes", F.lit(1).cast("long")))
        last = F.coalesce(f"{other}_lanes", F.lit(1).cast("long")) - 1
        laned = side.join(large, "batch_id", "left").withColumn(f"{own}_lane", of_own)
        copies = F.explode(F.sequence(F.lit(0).cast("long"), last))
        return laned.withColumn(f"{other}_lane", copies).drop("c_lanes", "r_lanes")

    return spread(contexts, "c", "r", "i"), spread(responses, "r", "c", "j")


def score_matrix(contexts: DataFrame, responses: DataFrame, squash: bool = False) -> DataFrame:
    """Score every context of a batch with every response of that batch.

    Both sides are ``(batch_id, slot, vector)``; the result is the long form
    ``(batch_id, i, j, score)``, whose size follows the batch size. The join is
    on batch and lanes, so that no single batch has to fit one task.
    """
    left, right = _laned(
        contexts.select("batch_id", F.col("slot").alias("i"), F.col("vector").alias("c")),
        responses.select("batch_id", F.col("slot").alias("j"), F.col("vector").alias("r")),
    )
    score = L.dot("c", "r")
    return left.join(right, ["batch_id", "c_lane", "r_lane"]).select(
        "batch_id", "i", "j", (L.sigmoid(score) if squash else score).alias("score")
    )


def _with_positive(scores: DataFrame) -> DataFrame:
    """Each score beside its anchor's diagonal score; one shuffle, no self-join."""
    anchor = Window.partitionBy("batch_id", "i")
    diagonal = F.max(F.when(F.col("i") == F.col("j"), F.col("score"))).over(anchor)
    return scores.withColumn("positive", diagonal).filter(F.col("positive").isNotNull())


def _relevant(margin: float) -> Column:
    return F.col("score") - F.col("positive") + F.lit(float(margin)) > 0


def anchor_losses(scores: DataFrame, margin: float = V.TRIPLET_MARGIN) -> DataFrame:
    """Loss per anchor; an anchor without a relevant negative has loss 0.

    ``loss`` averages the negatives within the margin, ``all_loss`` all of them.
    """
    negative = F.col("i") != F.col("j")
    relevant = negative & _relevant(margin)
    per_anchor = (
        _with_positive(scores)
        .groupBy("batch_id", "i")
        .agg(
            F.max("positive").alias("positive"),
            F.avg(F.when(relevant, F.col("score"))).alias("hard_mean"),
            F.avg(F.when(negative, F.col("score"))).alias("all_mean"),
            F.count_if(relevant).alias("n_relevant"),
        )
    )

    def hinge(mean: str) -> Column:
        gap = F.col(mean) - F.col("positive") + F.lit(float(margin))
        return F.coalesce(F.greatest(gap, F.lit(0.0)), F.lit(0.0))

    return per_anchor.select(
        "batch_id",
        "i",
        "n_relevant",
        hinge("hard_mean").alias("loss"),
        hinge("all_mean").alias("all_loss"),
        (F.col("n_relevant") == 0).alias("no_hard"),
    )


def triplet_loss(scores: DataFrame, margin: float = V.TRIPLET_MARGIN) -> DataFrame:
    """Batch means of both losses, and how many anchors had no hard negative."""
    return (
        anchor_losses(scores, margin)
        .groupBy("batch_id")
        .agg(
            F.avg("loss").alias("loss"),
            F.avg("all_loss").alias("all_loss"),
            F.sum("n_relevant").alias("n_relevant"),
            F.count_if("no_hard").alias("no_hard"),
        )
    )


def hard_triplets(scores: DataFrame, margin: float = V.TRIPLET_MARGIN) -> DataFrame:
    """Triplets (anchor, positive, negative) within the margin, hard or semi-hard."""
    hard = F.col("score") > F.col("positive")
    return (
        _with_positive(scores)
        .filter((F.col("i") != F.col("j")) & _relevant(margin))
        .select(
            "batch_id",
            F.col("i").alias("anchor"),
            F.col("j").alias("negative"),
            F.col("positive").alias("positive_score"),
            F.col("score").alias("negative_score"),
            F.when(hard, "hard").otherwise("semi-hard").alias("kind"),
        )
    )


def _best_of(context_ids, contexts, response_ids, responses, k: int, digits: int | None):
    """Top ``k`` responses of this block for each context, ties by response id."""
    order = np.argsort(response_ids, kind="stable")
    response_ids, responses = response_ids[order], responses[order]
    k = min(k, len(response_ids))
    for start in range(0, len(context_ids), STRIP):
        scores = contexts[start : start + STRIP] @ responses.T
        scores = scores if digits is None else np.round(scores, digits)
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        for row, line in enumerate(scores):
            # Everything as good as the k-th, so that ties are cut by id.
            near = np.flatnonzero(line >= bar[row])
            best = near[np.argsort(-line[near], kind="stable")][:k]
            for b in best:
                yield context_ids[start + row], response_ids[b], line[b]


def _matrix(vectors) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


COLUMNS = ["context_id", "response_id", "score"]


def _best_so_far(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts).sort_values(COLUMNS[::2] + COLUMNS[1:2], ascending=[True, False, True])
    return every.groupby("context_id", sort=False).head(k)


def _shared_contexts(
    contexts: DataFrame, responses: DataFrame, k: int, schema: str, digits: int | None
) -> DataFrame:
    """Few contexts: every task holds them, streams its responses, and emits its best once."""
    held = contexts.toPandas()
    if held.empty:
        return contexts.sparkSession.createDataFrame([], schema)
    shared = contexts.sparkSession.sparkContext.broadcast(
        (held["context_id"].to_numpy(), _matrix(held["vector"]))
    )

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        held, size = [], 0
        for b in batches:
            if len(b):
                vectors = _matrix(b["vector"])
                found = _best_of(ids, matrix, b["response_id"].to_numpy(), vectors, k, digits)
                held.append(pd.DataFrame(found, columns=COLUMNS))
                size += len(held[-1])
                if size > 4 * k * len(ids):
                    held = [_best_so_far(held, k)]
                    size = len(held[0])
        if held:
            yield _best_so_far(held, k)

    return responses.mapInPandas(best, schema)


def _blocked(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with a block number; blocks hold about ``size`` rows each."""
    kept = materialize(rows, "rank-side")
    blocks = max(1, math.ceil(kept.count() / size))
    return kept.withColumn(name, F.pmod(F.xxhash64(*rows.columns), F.lit(blocks))), blocks


def _grid(
    contexts: DataFrame, responses: DataFrame, k: int, schema: str, digits: int | None
) -> DataFrame:
    """Many contexts: each pair of blocks meets in one task, which emits its best."""
    left, n_left = _blocked(contexts, CONTEXT_BLOCK, "c_block")
    right, n_right = _blocked(responses, RESPONSE_BLOCK, "r_block")
    left = left.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"context_id": [], "response_id": [], "score": []})
        found = _best_of(
            a["context_id"].to_numpy(),
            _matrix(a["vector"]),
            b["response_id"].to_numpy(),
            _matrix(b["vector"]),
            k,
            digits,
        )
        return pd.DataFrame(found, columns=COLUMNS)

    keys = ["c_block", "r_block"]
    cells = left.withColumn("r_block", F.col("r_block").cast("long")).groupBy(*keys)
    others = right.withColumn("c_block", F.col("c_block").cast("long")).groupBy(*keys)
    return cells.cogroup(others).applyInPandas(best, schema)


def select_responses(
    contexts: DataFrame,
    responses: DataFrame,
    k: int,
    context_values: int = CONTEXT_VALUES,
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` best stored responses of every context, exactly.

    ``contexts`` is ``(context_id, vector)``, ``responses`` is
    ``(response_id, vector)``. Pairs are scored as matrix products inside the
    tasks and only each block's best leave them, so pairs are never rows.
    Contexts are shared with the executors when they are few, and otherwise
    meet the responses block by block: every context is copied to every response
    block and every response to every context block. Rows with a NULL vector are
    left out. With ``digits`` scores are rounded first, and what is then equal is
    ranked by response id.
    """
    contexts = contexts.filter("vector is not null")
    responses = responses.filter("vector is not null")
    first = contexts.select(F.size("vector").alias("dim")).first()
    kind = contexts.schema["context_id"].dataType.simpleString()
    other = responses.schema["response_id"].dataType.simpleString()
    schema = f"context_id {kind}, response_id {other}, score double"
    contexts = contexts.select("context_id", "vector")
    responses = responses.select("response_id", "vector")
    few = at_most(contexts, context_values // max(1, first.dim)) if first else True
    found = (_shared_contexts if few else _grid)(contexts, responses, k, schema, digits)
    order = Window.partitionBy("context_id").orderBy(F.desc("score"), "response_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
