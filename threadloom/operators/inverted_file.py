"""Selecting responses through an inverted file: cells of like vectors, of which a context probes some.

The cells' centers are learned from a bounded sample; every response is put into
the cell it scores best with. A context meets only the responses of the cells it
scores best with, block by block, and their scores are exact. What the probes miss is
measured against the exact selection by ``recall``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ranking import COLUMNS
from threadloom.operators.ranking import _best_of as best_of
from threadloom.operators.ranking import _matrix as matrix
from threadloom.session import Scratch

#: Vectors that centers are learned from, at most; the driver holds them.
SAMPLE = 20_000
ROUNDS = 12
#: Responses of a cell that one task holds; a larger cell is cut into blocks.
BLOCK = 20_000
LANE = 2_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def learn_cells(responses: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Unit centers of at most ``cells`` cells, by k-means over directions of ``sample`` responses.

    The sample is the responses of the smallest seeded hashes, so reruns agree.
    """
    drawn = responses.select("vector", F.xxhash64(F.lit(seed), "response_id").alias("h"))
    rows = drawn.orderBy("h").limit(sample).select("vector").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    vectors = _unit(matrix(rows["vector"]))
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centers = distinct[rng.permutation(len(distinct))[:cells]].copy()
    for _ in range(ROUNDS):
        nearest = (vectors @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        filled = np.bincount(nearest, minlength=len(centers)) > 0
        centers[filled] = _unit(sums[filled])
    return centers


def _with_cells(rows: DataFrame, shared, probes: int, name: str) -> DataFrame:
    """The rows once for each of the ``probes`` cells they score best with."""
    kind = rows.schema[name].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = shared.value
        for b in batches:
            if not len(b):
                continue
            scores = matrix(b["vector"]) @ centers.T
            n = min(probes, scores.shape[1])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            at = np.repeat(np.arange(len(b)), n)
            yield pd.DataFrame({name: b[name].to_numpy()[at], "vector": b["vector"].to_numpy()[at], "cell": top.ravel()})

    return rows.mapInPandas(placed, f"{name} {kind}, vector array<double>, cell int")


class ResponseIndex:
    """Responses by cell and block, written once; any number of selections read it."""

    def __init__(self, responses: DataFrame, cells: int, sample: int = SAMPLE, block: int = BLOCK, seed: int = 0) -> None:
        spark = responses.sparkSession
        tables = Scratch(spark, "inverted-file")
        rows = responses.filter("vector is not null").select("response_id", F.col("vector").cast("array<double>").alias("vector"))
        self.kind = rows.schema["response_id"].dataType.simpleString()
        rows = tables.table(rows, "responses")
        centers = learn_cells(rows, cells, sample, seed)
        self.cells = len(centers)
        self.centers = spark.sparkContext.broadcast(centers)
        if not self.cells:
            return
        placed = tables.table(_with_cells(rows, self.centers, 1, "response_id"), "cells")
        # a row per cell: bounded by the number of centers
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / block).alias("blocks"))
        self.blocks = tables.table(sizes, "blocks")
        spread = F.pmod(F.xxhash64("response_id"), F.col("blocks")).cast("int")
        self.rows = placed.join(F.broadcast(self.blocks), "cell").select("cell", spread.alias("block"), "response_id", "vector")

    def select(self, contexts: DataFrame, k: int, probes: int) -> DataFrame:
        """The ``k`` best responses of every context among the cells it probes, with exact scores."""
        kind = contexts.schema["context_id"].dataType.simpleString()
        schema = f"context_id {kind}, response_id {self.kind}, score double"
        if not self.cells:
            return contexts.sparkSession.createDataFrame([], schema + ", rank int")
        rows = contexts.filter("vector is not null").select("context_id", F.col("vector").cast("array<double>").alias("vector"))
        asked = _with_cells(rows, self.centers, probes, "context_id").join(F.broadcast(self.blocks), "cell")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        # a cell that very many contexts probe is met in lanes
        lane = F.pmod(F.xxhash64("context_id"), F.col("lanes")).cast("int")
        crowd = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / LANE).alias("lanes"))
        left = asked.join(F.broadcast(crowd), ["cell", "block"]).select("cell", "block", lane.alias("lane"), "context_id", "vector")
        right = self.rows.join(F.broadcast(crowd), ["cell", "block"])
        right = right.withColumn("lane", F.explode(F.sequence(F.lit(0), (F.col("lanes") - 1).cast("int"))))
        right = right.select("cell", "block", "lane", "response_id", "vector")

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({c: [] for c in COLUMNS})
            found = best_of(a["context_id"].to_numpy(), matrix(a["vector"]), b["response_id"].to_numpy(), matrix(b["vector"]), k, None)
            return pd.DataFrame(found, columns=COLUMNS)

        keys = ["cell", "block", "lane"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)
        order = Window.partitionBy("context_id").orderBy(F.desc("score"), "response_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def select_responses_indexed(
    contexts: DataFrame, responses: DataFrame, k: int, cells: int, probes: int, sample: int = SAMPLE, seed: int = 0
) -> DataFrame:
    """``select_responses`` through an index of ``cells`` cells, of which each context probes ``probes``."""
    return ResponseIndex(responses, cells, sample, seed=seed).select(contexts, k, probes)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact selection's rows that ``found`` has."""
    both = exact.select("context_id", "response_id").join(found.select("context_id", "response_id").withColumn("hit", F.lit(1)), ["context_id", "response_id"], "left")
    seen = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return seen["hits"] / seen["n"] if seen["n"] else 1.0
