"""Word vectors, embedding tables and pooling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions import vectors as L
from threadloom.session import at_most, broadcast_if_small, materialize, parallelism, scratch

MATRIX_VALUES = 32_000_000
#: Ids of sentences that one partition of the trainer goes through.
PARTITION_IDS = 16_000_000
#: Numbers of vectors that a task gathers at a time.
BLOCK_VALUES = 1 << 21
#: Numbers of vectors that a shelf of rows can ask for.
SHELF_VALUES = 1 << 23


def digit_sentences(encoded: DataFrame, column: str = "ids") -> DataFrame:
    """Encoded turns as sentences of digit strings."""
    return encoded.select(F.transform(column, lambda x: x.cast("string")).alias("sentence"))


def train_word_vectors(
    sentences: DataFrame,
    dim: int = V.WORD_VECTOR_DIM,
    min_count: int = 1,
    seed: int = V.SPLIT_SEED,
    iterations: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Skip-gram vectors ``(id, vector)`` of the ids in the sentences.

    Sentences are written once, as the trainer reads them twice. ``partitions`` are
    trained side by side; where one would have more than ``PARTITION_IDS`` ids, they are more.
    """
    spark = sentences.sparkSession
    with scratch(spark, "sentences") as tables:
        rows = tables.table(sentences.select("sentence"), "sentences")
        ids = rows.agg(F.sum(F.size("sentence").cast("long"))).first()[0] or 0
        model = Word2Vec(
            inputCol="sentence",
            vectorSize=dim,
            minCount=min_count,
            seed=seed,
            maxIter=iterations,
            numPartitions=max(partitions or parallelism(spark), -(-ids // PARTITION_IDS)),
        ).fit(rows)
    return model.getVectors().select(
        F.col("word").cast("int").alias("id"), vector_to_array("vector", "float32").alias("vector")
    )


def embedding_table(
    vectors: DataFrame,
    n_ids: int,
    dim: int = V.WORD_VECTOR_DIM,
    seed: int = V.SPLIT_SEED,
    init: str = "normal",
) -> DataFrame:
    """One vector for each of ``n_ids`` ids: the given one, or a seeded draw."""
    ids = vectors.sparkSession.range(n_ids).select(F.col("id").cast("int").alias("id"))
    draw = {"normal": L.seeded_normal, "uniform": L.seeded_uniform}[init](F.col("id"), dim, seed)
    return ids.join(vectors.select("id", "vector"), "id", "left").select(
        "id",
        F.when(F.col("vector").isNull(), draw).otherwise(F.col("vector"))
        .cast("array<float>")
        .alias("vector"),
    )


def lookup_vectors(rows: DataFrame, table: DataFrame, key: str, column: str = "ids") -> DataFrame:
    """``(key, pos, id, vector)`` for every id of every row, padding included."""
    ids = rows.select(key, F.posexplode(column).alias("pos", "id"))
    return ids.join(broadcast_if_small(table), "id", "left").select(key, "pos", "id", "vector")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in their own precision; missing numbers are NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype.kind != "f":
        flat = flat.astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _sums(owner: np.ndarray, place: np.ndarray, matrix: np.ndarray, rows: int) -> np.ndarray:
    """Sum of ``matrix[place]`` for each owner, owners in order; gathers ``BLOCK_VALUES`` at a time."""
    total = np.zeros((rows, matrix.shape[1]))
    step = max(1, BLOCK_VALUES // max(1, matrix.shape[1]))
    for begin in range(0, len(owner), step):
        some = owner[begin : begin + step]
        starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        found = matrix[place[begin : begin + step]].astype(np.float64, copy=False)
        total[some[starts]] += np.add.reduceat(found, starts)
    return total


def _used(lists: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place in ``known`` of every listed id that counts."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    valid = np.ones(len(flat), bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
    flat = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    valid &= flat != V.UNKNOWN_ID
    owner, flat = owner[valid], flat[valid]
    if not len(known):
        return owner[:0], np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    found = known[place] == flat
    return owner[found], place[found]


def _lists(starts_at: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """A list array of ``rows`` rows: ``values`` at the rows ``starts_at``, NULL elsewhere."""
    sizes = np.zeros(rows + 1, np.int64)
    sizes[starts_at + 1] = values.shape[1]
    is_null = np.ones(rows, bool)
    is_null[starts_at] = False
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(sizes), pa.int32()), pa.array(values.ravel()), mask=pa.array(is_null)
    )


def _pool_on_matrix(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pooling in place with the (small) table held by every executor."""
    held = table.select("id", "vector").toArrow().sort_by("id").combine_chunks()
    ids = held.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((_matrix(held.column("vector").combine_chunks()), ids))

    @F.arrow_udf("array<double>")
    def pool(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, known = shared.value
        for lists in batches:
            owner, place = _used(lists, known)
            n = np.bincount(owner, minlength=len(lists))
            hit = np.flatnonzero(n)
            # the rows that have a vector, one after another
            means = _sums(np.searchsorted(hit, owner), place, vectors, len(hit)) / n[hit, None]
            yield _lists(hit, means, len(lists))

    # Kept whole: a filter on the result must not run the pooling twice.
    return rows.withColumn("pooled", pool.asNondeterministic()(column))


def _shelves(size: Column, most: int) -> Column:
    """Numbers of shelves: rows that stand together and hold ``most`` ids at most, but for a longer row alone."""

    @F.arrow_udf("long")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shelf, held = 0, 0
        for sizes in batches:
            out = []
            for n in sizes.to_pylist():
                held += max(1, n)
                if held > most:
                    shelf, held = shelf + 1, max(1, n)
                out.append(shelf)
            yield pa.array(out, pa.int64())

    own = number.asNondeterministic()(F.coalesce(size, F.lit(0)))
    return F.shiftleft(F.spark_partition_id().cast("long"), 33) + own


def _pooled_shelf(rows: pa.Table, table: pa.Table) -> pa.Table:
    """Sums and counts of every dimension for the rows (n_row, ids) of a shelf, by its own vectors."""
    table = table.sort_by("id").combine_chunks()
    known = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    vectors = table.column("vector").combine_chunks()
    lists = rows.column("ids").combine_chunks()
    owner, place = _used(lists, known)
    n = np.bincount(owner, minlength=len(lists))
    hit = np.flatnonzero(n)
    owner, n = np.searchsorted(hit, owner), n[hit]
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    flat = vectors.flatten()
    if flat.null_count or (sizes != width).any():
        # of vectors without a number there, the count stays and the sum does not
        grid = np.arange(width) < sizes[:, None]
        matrix, given = np.zeros(grid.shape), np.zeros(grid.shape, bool)
        matrix[grid] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        given[grid] = flat.is_valid().to_numpy(zero_copy_only=False)
        total = _sums(owner, place, matrix, len(hit))
        count = _sums(owner, place, grid, len(hit)).astype(np.int64)
        is_null = _sums(owner, place, given, len(hit)) == 0
        kept = count > 0
        bounds = pa.array(np.append(0, np.cumsum(kept.sum(axis=1))), pa.int32())
        totals = pa.ListArray.from_arrays(bounds, pa.array(total[kept], mask=is_null[kept]))
        counts = pa.ListArray.from_arrays(bounds, pa.array(count[kept]))
    else:
        total = _sums(owner, place, _matrix(vectors), len(hit)) if len(hit) else np.zeros((0, 0))
        bounds = pa.array(np.arange(len(hit) + 1) * width, pa.int32())
        totals = pa.ListArray.from_arrays(bounds, pa.array(total.ravel()))
        counts = pa.ListArray.from_arrays(bounds, pa.array(np.repeat(n, width)))
    n_row = rows.column("n_row").combine_chunks().take(pa.array(hit))
    return pa.table({"n_row": n_row, "total": totals, "n": counts})


def _pool_by_join(rows: DataFrame, table: DataFrame, column: str, dim: int = V.WORD_VECTOR_DIM) -> DataFrame:
    """Pooling for a table of any size, on shelves of rows that stand together.

    A shelf asks for each of its ids once and gets their vectors, so what moves is
    the ids, and a vector for each id of a shelf. A row longer than a shelf is cut, and
    the sums of its pieces are added up.
    """
    most = max(1, SHELF_VALUES // max(1, dim))
    size = F.size(F.col(column))
    numbered = materialize(
        rows.select(
            F.struct("*").alias("row"),
            F.monotonically_increasing_id().alias("n_row"),
            _shelves(size, most).alias("shelf"),
        ),
        "numbered-rows",
    )
    ids = F.col("row")[column]
    cut = F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((size(row.`{column}`) - 1) div {most} as int)")),
        lambda p: F.slice(ids, p * most + 1, F.lit(most)),
    )
    pieces = numbered.filter(F.size(ids) > 0).select(
        "shelf", "n_row", F.posexplode(F.when(F.size(ids) <= most, F.array(ids)).otherwise(cut)).alias("piece", "ids")
    )
    wanted = pieces.select(
        F.col("shelf").alias("to_shelf"), F.col("piece").alias("to_piece"), F.explode(F.array_distinct("ids")).alias("id")
    )
    wanted = wanted.filter(F.col("id") != V.UNKNOWN_ID).distinct()
    vectors = wanted.join(table.select("id", "vector"), "id").select("to_shelf", "to_piece", "id", "vector")
    sums = (
        pieces.groupBy("shelf", "piece")
        .cogroup(vectors.groupBy("to_shelf", "to_piece"))
        .applyInArrow(_pooled_shelf, "n_row long, total array<double>, n array<long>")
    )
    parts = sums.groupBy("n_row").agg(F.collect_list(F.struct("total", "n")).alias("parts"))
    first, rest = F.element_at("parts", 1), F.slice("parts", F.lit(2), F.size("parts"))
    whole = F.aggregate(
        rest,
        first,
        lambda a, b: F.struct(
            F.zip_with(a["total"], b["total"], lambda x, y: F.coalesce(x + y, x, y)).alias("total"),
            F.zip_with(a["n"], b["n"], lambda x, y: F.coalesce(x + y, x, y)).alias("n"),
        ),
    )
    summed = parts.select("n_row", F.when(F.size("parts") == 1, first).otherwise(whole).alias("sum"))
    mean = F.zip_with("sum.total", "sum.n", lambda x, n: x / n)
    pooled = summed.filter(F.size("sum.n") > 0).select("n_row", mean.alias("pooled"))
    return numbered.join(pooled, "n_row", "left").select("row.*", "pooled")


def mean_pool(
    rows: DataFrame, table: DataFrame, column: str = "ids", matrix_values: int = MATRIX_VALUES
) -> DataFrame:
    """Add ``pooled``: the mean vector of a row's ids other than 0, or NULL.

    A table of at most ``matrix_values`` numbers is shared with the executors
    and rows stay in place; a larger one is joined. Of an id listed twice the
    greater vector counts, NULL vectors are left out, and rows need no key.
    """
    table = (
        table.filter("id is not null and vector is not null")
        .groupBy("id")
        .agg(F.max("vector").alias("vector"))
    )
    first = table.select(F.size("vector").alias("dim")).first()
    limit = matrix_values // max(1, first.dim) if first else 0
    if first and at_most(table, limit):
        return _pool_on_matrix(rows, table, column)
    return _pool_by_join(rows, table, column, first.dim if first else 1)


def logistic_scores(
    rows: DataFrame, weights: Sequence[float], bias: float = 0.0, column: str = "pooled"
) -> DataFrame:
    return rows.withColumn("score", L.logistic(column, weights, bias))
