"""Documents in, training mixture out: each stage calls one operator and keeps whole columns.

``STAGES`` are applied in order; each stage's result is written as Parquet and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontamination, minhash, mixing, pii, quality_classifier
from threadloom.session import materialize

#: Sampling, learning and graph stages cannot be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


#: Rows that go to Python at once: with whole texts, Spark's 10,000 fill tens of MB beside each task.
ARROW_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _whole_texts(spark: SparkSession) -> None:
    """From here on the session hands texts to Python in batches that suit their length; ``run`` ends that."""
    if int(spark.conf.get(BATCH_ROWS)) > ARROW_ROWS:
        spark.conf.set(BATCH_ROWS, str(ARROW_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    _whole_texts(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    _whole_texts(spark)
    return minhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or within its edit budget."""
    _whole_texts(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data written as its kind."""
    _whole_texts(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with how often as ``copies``."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_ROWS)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        # the last stage hands nothing to Python
        spark.conf.set(BATCH_ROWS, before)
    return STAGES[-1][1](spark, docs, sf_dir)
