"""Small helpers around the caller's session: scratch tables and size checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of local sessions without ``spark.checkpoint.dir``, by application id.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for lineage-cutting tables: what ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is an error, because executors could not see a folder
    of the driver's machine. The setting itself is never written.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="threadloom-")
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back without lineage.

    A Parquet table keeps column pruning and gives the planner real sizes, so
    later joins choose broadcast or shuffle from facts. ``path`` may be one of
    ``scratch``, so that the table goes with its scope.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that holds it."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch tables of one operator call, under one folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self._n = spark, fresh_path(spark, label), 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label, self.path(label))

    def remove(self) -> None:
        """Delete all tables of the call."""
        remove(self.spark, self.root)

    def drop(self, df: DataFrame) -> None:
        """Delete a superseded table made by ``table``."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(self.spark, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[Scratch]:
    """Tables that are deleted at the end of the block, so use only what is written by then."""
    tables = Scratch(spark, label)
    try:
        yield tables
    finally:
        remove(spark, tables.root)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 50_000, size: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a dimension proven small, in rows and in bytes.

    Above either bound the frame comes back without a hint and the join is
    shuffled, with skewed partitions split by adaptive execution.
    """
    width = F.length(F.to_json(F.struct("*"))).cast("long")
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if seen.n <= rows and (seen.size or 0) <= size else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
