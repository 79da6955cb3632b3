"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b); comp is the component's smallest node.

    Each round takes the smallest label among neighbours and then the label of
    that label, so the rounds follow the logarithm of the longest path. Labels are
    written between rounds; a node with very many neighbours only adds to a
    minimum that is taken before the shuffle.
    """
    both = tables.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = tables.table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")),
        "labels",
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("mid")
        )
        spread = tables.table(spread, "spread")
        far = spread.select(F.col("node").alias("far"), F.col("mid").alias("jump"))
        new = tables.table(
            spread.join(far, spread["mid"] == far["far"], "left").select("node", "was", F.least("mid", F.coalesce("jump", "mid")).alias("comp")),
            "labels",
        )
        changed = new.where(F.col("was") != F.col("comp")).limit(1).count()
        tables.drop(spread)
        tables.drop(labels)
        labels = new.select("node", "comp")
        if not changed:
            return labels
