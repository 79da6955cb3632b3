"""Line dedup over a whole corpus, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys
of at least ``MIN_KEY`` code points that two or more documents hold lose all
their lines except in the smallest doc_id.

Keys go as 128-bit hashes beside document and position, never as text. They are
dealt out by range of the hash and sorted by hash, document and position, so
that the first occurrence streams past ahead of its repeats. What comes back
for a document is its keep bitmap in run form, the runs of lines that stay; texts
meet only their own bitmap.

Hot keys: a frequent-items sketch names every key that could fill a task. The
rows of such a key are cut into slices that are sorted apart, and the first
documents of the slices (a bounded number) give the key's first document. The
sketch decides only how rows are dealt, never what the result is.

A null or empty text is one empty line. Rows of one doc_id are one document, so
they never take a line from each other; rows of null ids are one document after
all others. Equal rows are judged alike. An empty table gives an empty result.
Texts of any length are taken whole; a document with all lines gone has an
empty text. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import Scratch, parallelism

MIN_KEY = 10
SLICES = 4_096
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ["doc_id", "t1", "t2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _two_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit hash of the text, and the text; a null text is empty."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = _two_hashes(F.col("text"))
    return plain.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")


def _lines(rows: DataFrame, min_key: int) -> DataFrame:
    """One row per line whose key counts: key hashes, document, position, and a number that spreads rows."""
    found = rows.select(*_ROW, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = found.select(*_ROW, "pos", line_key(F.col("line")).alias("line_key")).where(F.char_length("line_key") >= min_key)
    k1, k2 = _two_hashes(F.col("line_key"))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)).cast("int")
    return keyed.select(k1.alias("k1"), k2.alias("k2"), *_ROW, "pos", spread.alias("spread"))


def _hot(lines: DataFrame, tasks: int) -> DataFrame:
    """Keys that may hold more than a quarter of a task's rows, by sketch: at most ``4 * tasks`` rows."""
    tracked = min(1_000_000, max(4_096, 16 * tasks))
    most = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k1, {min(4 * tasks, tracked)}, {tracked})").alias("top"))
    top = most.select("n", F.inline("top")).where(F.col("count") * 4 * tasks > F.col("n"))
    return top.select(F.col("item").alias("k1"), F.lit(True).alias("hot"))


def _dropped(lines: DataFrame, tables: Scratch, tasks: int) -> DataFrame:
    """Rows (doc_id, t1, t2, pos) of lines that stand in an earlier document."""
    hot = tables.table(_hot(lines, tasks), "hot-keys")
    sliced = lines.join(F.broadcast(hot), "k1", "left").withColumn(
        "slice", F.when(F.col("hot"), F.col("spread")).otherwise(F.lit(-1))
    )
    sliced = sliced.withColumn("doc", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id"))
    cell = ["k1", "k2", "slice"]
    stream = Window.partitionBy(*cell).orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ranges of (hash, slice) already hold whole cells, so the window sorts but does not shuffle again
    first = sliced.repartitionByRange(tasks, *cell).withColumn("first", F.first("doc").over(stream))
    seen = tables.table(first.where("doc != first or slice >= 0"), "repeats")
    # of hot keys every slice has rows; the least first document of at most 4 * tasks keys
    heads = seen.where("slice >= 0").groupBy("k1", "k2").agg(F.min("first").alias("head"))
    late = seen.join(F.broadcast(heads), ["k1", "k2"], "left")
    return late.where(F.col("doc") != F.coalesce("head", "first")).select(*_ROW, "pos")


def _marked(docs: DataFrame, min_key: int) -> DataFrame:
    """Every row of ``docs`` as doc_id, text, n_lines, n_dropped and the runs of lines that stay."""
    spark = docs.sparkSession
    tables = Scratch(spark, "line-dedup")
    rows, tasks = _rows(docs), parallelism(spark)
    lines = tables.table(_lines(rows, min_key), "lines")
    gone = _dropped(lines, tables, tasks).groupBy(*_ROW).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    size = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    left, right = rows.withColumn("n_lines", size.cast("long")).alias("l"), gone.alias("r")
    same = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("l.t1") == F.col("r.t1")) & (F.col("l.t2") == F.col("r.t2"))
    joined = left.join(right, same, "left").select("l.doc_id", "l.text", "l.n_lines", "r.gone")
    return joined.select(
        "doc_id",
        "text",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        _kept_runs(F.col("gone"), F.col("n_lines").cast("int")).alias("kept_runs"),
    )


def _kept_runs(gone: Column, n_lines: Column) -> Column:
    """Runs (first, n) of positions below ``n_lines`` that are not in the ascending ``gone``."""
    # the run before the first dropped line, and the one after each; ``gone`` is read in place, never rebuilt
    after = F.transform(
        F.concat(F.array(F.lit(-1)), gone),
        lambda p, i: F.struct(
            (p + 1).alias("first"), (F.coalesce(F.get(gone, i), n_lines) - p - 1).alias("n")
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("first"), n_lines.alias("n")))
    return F.when(gone.isNull(), whole).otherwise(F.filter(after, lambda r: r["n"] > 0))


def apply_runs(text: Column, kept_runs: Column) -> Column:
    """The lines of ``text`` that the runs keep, joined again."""
    # a struct in an array of one: the text is split once, and each run only slices
    parts = F.array(F.struct(F.split(text, "\n").alias("lines"), kept_runs.alias("runs")))
    joined = F.transform(
        parts,
        lambda s: F.array_join(
            F.flatten(F.transform(s["runs"], lambda r: F.slice(s["lines"], r["first"] + 1, r["n"]))), "\n"
        ),
    )
    return F.element_at(joined, 1)


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept_runs`` of every row of ``docs``: its keep bitmap as runs (first, n)."""
    return _marked(docs, min_key).select("doc_id", "n_lines", "n_dropped", "kept_runs")


def without_repeats(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left of every row of ``docs``."""
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(apply_runs(F.col("text"), F.col("kept_runs")))
    return _marked(docs, min_key).select("doc_id", "n_lines", "n_dropped", kept.alias("text"))


def digest(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of every row of ``docs``."""
    left = without_repeats(docs, min_key)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
