"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. For every (lang,
source) the minimum-covariance-determinant estimate, found by concentration
steps from a median-and-spread start, gives a center and a scatter that junk
cannot pull along; a document is rejected if its squared Mahalanobis distance
is beyond the ``QUANTILE`` of the matching chi-squared law.

Every concentration step covers all rows in one job: rows look their group's
estimate up, are counted with their moments into bins of log distance, and the
bins (bounded per group) up to half of the rows give the next estimate. No
group is gathered, however large. Groups under ``LEAST`` rows are pooled, per
language first and then all together. If that last pool is still under ``LEAST``,
its rows are held against an estimate over all rows of the table and have no
distance of their own; a table under ``LEAST`` has a cut that widens as its rows
get fewer (``FEW``). Scatters get a floor per statistic (``FLOORS``), so that a statistic
which is the same in most documents does not make any other value an outlier,
but only one beyond what is usual in prose: lines and words are repeated in good
documents too, symbols hardly are there.

Null and empty texts have no words and fail the base rules. Null languages and
sources are groups of their own. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spans import Chunk, chunks, mix, per_document, span_hash, text_bytes
from threadloom.session import Scratch

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("v0", "v1", "v2", "v3", "v4")
LEAST = 200
STEPS = 4
HALF = 0.5
#: By the quantile below, a statistic that is 0 elsewhere rejects alone from about 5 % of symbols, 30 % of repeated lines or 50 %
#: of repeated words (the base rule's limit) on, a word length from 1.36 times its group's.
FLOORS = (0.12, 0.089, 0.229, 0.31, 0.12)
QUANTILE = 0.9999
FEW = 15.0
BINS_PER_OCTAVE = 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_K = np.uint64(0x9E3779B97F4A7C15)


def _statistics(chunk: Chunk) -> list[np.ndarray]:
    """The STATS of each document, then its capital letters and lines."""
    data, bounds = chunk.data, chunk.offsets
    starts, ends, owner = chunk.words()
    prefix = chunk.prefix()
    first = np.searchsorted(owner, np.arange(chunk.n + 1))
    n_words = np.diff(first)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = per_document(points[ends] - points[starts], first)
    n_symbols = per_document(_SYMBOL[data], bounds)
    upper = per_document(_UPPER[data], bounds)

    # lines: from a document's begin or a newline to the next newline or its end
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(chunk.n), chunk.owner(breaks)]), kind="stable")
    line_end = np.append(line_start[1:], len(data))
    line_end = np.minimum(np.where(np.append(line_doc[1:] == line_doc[:-1], False), line_end - 1, bounds[line_doc + 1]), bounds[line_doc + 1])
    solid = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_hash = span_hash(prefix, line_start[solid], line_end[solid])
    line_doc = line_doc[solid]
    dup = np.bincount(line_doc[_again(line_hash, line_doc)], minlength=chunk.n)

    word = span_hash(prefix, starts, ends)
    repeat = np.zeros(len(word), bool)
    if len(word) > 2:
        triple = mix((word[:-2] * _K + word[1:-1]) * _K + word[2:])
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        often = inside[_shared(triple[inside], owner[inside])]
        for i in range(3):
            repeat[often + i] = True
    n_repeat = per_document(repeat, first)
    return [n_words, word_chars, n_symbols, dup, n_repeat, upper, np.bincount(line_doc, minlength=chunk.n)]


def _again(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose value occurs earlier in the same document."""
    order = np.lexsort((value, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order[same]


def _shared(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose value occurs twice or more in the same document."""
    key = value ^ mix(doc.astype(np.uint64) + _K)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    both = np.append(equal, False) | np.insert(equal, 0, False)
    return order[both]


_SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,upper:bigint,lines:bigint>"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "lines")


def _measured(texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    parts = [_statistics(chunk) for chunk in chunks(data, offsets)]
    columns = [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for i in range(len(_FIELDS))]
    return pa.StructArray.from_arrays(columns, names=list(_FIELDS))


def statistics(text: Column) -> Column:
    """Struct of the base statistics of a text, with capital letters and lines."""
    return F.arrow_udf(_measured, _SCHEMA)(text)


def _vector(s: Column) -> list[Column]:
    """Transformed statistics. Rates are smoothed towards 0 by 50 words, so that short texts scatter less; that of symbols by 20."""
    words = s["n_words"].cast("double")
    chars = s["word_chars"].cast("double")

    def rate(count: Column, of: Column, extra: float) -> Column:
        return F.asin(F.sqrt(F.least(count / (of + extra), F.lit(1.0)))) * 2

    return [
        F.log((chars + 50 * 5) / (words + 50)) * 2,
        rate(s["n_symbols"], chars, 100.0),
        rate(s["n_dup_lines"], s["lines"].cast("double"), 10.0),
        rate(s["n_repeat_words"], words, 50.0),
        rate(s["upper"], chars, 250.0),
    ]


def _chi_squared(p: float, k: int) -> float:
    """Quantile by bisection on the regularised gamma function."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        a, half = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 400):
            term *= half / (a + n)
            total += term
        return total * exp(-half + a * log(half) - lgamma(a))

    low, high = 1e-6, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return low


def _moments() -> list[Column]:
    n = len(VECTOR)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    cross = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    return [F.count("*").alias("n"), *sums, *cross]


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Center and inverse scatter of the rows in the nearest bins that hold half of a group."""
    k = len(VECTOR)
    pdf = pdf.sort_values("bin")
    total = pdf["n"].sum()
    need = pdf["n"].cumsum().searchsorted(HALF * total) + 1
    near = pdf.iloc[:need]
    n = near["n"].sum()
    center = np.array([near[f"s{i}"].sum() for i in range(k)]) / n
    scatter = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            scatter[i, j] = scatter[j, i] = near[f"c{i}_{j}"].sum() / n - center[i] * center[j]
    # the half of a normal cloud nearest its center scatters less than the whole
    share = min(1.0, n / total)
    if share < 1:
        cut = _chi_squared(share, k)
        scatter *= share / max(_chi_inside(cut, k + 2), 1e-9)
    scatter += np.diag(np.square(FLOORS))
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "center": [center], "inverse": [np.linalg.inv(scatter).ravel()]})


def _chi_inside(x: float, k: int) -> float:
    from math import exp, lgamma, log

    a, half = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 400):
        term *= half / (a + n)
        total += term
    return total * exp(-half + a * log(half) - lgamma(a))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the estimate beside it."""
    n = len(VECTOR)
    gap = [F.col(v) - F.col("center")[i] for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(n):
        for j in range(n):
            total = total + gap[i] * gap[j] * F.col("inverse")[i * n + j]
    return total


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance, kept of every document."""
    tables = Scratch(docs.sparkSession, "quality-rules")
    measured = docs.select(
        "doc_id",
        F.to_json(F.array("lang", "source")).alias("fine"),
        F.to_json(F.array("lang")).alias("coarse"),
        statistics(docs["text"]).alias("s"),
    )
    failed = (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    rows = measured.select(
        "doc_id", "fine", "coarse", *[F.col("s")[c].alias(c) for c in STATS], failed.alias("base_failed"),
        *[c.alias(v) for c, v in zip(_vector(F.col("s")), VECTOR, strict=True)],
    )
    rows = tables.table(rows, "rows")
    judged = F.col("base_failed") == F.lit(False)
    # parts of groups: (lang, source), else (lang), else all
    fine = rows.where(judged).groupBy("fine", "coarse").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= LEAST)
    coarse = fine.where("not own").groupBy("coarse").agg(F.sum("n").alias("rest"))
    parts = fine.join(coarse, "coarse", "left").select(
        "fine", "n", F.when(F.col("own"), F.col("fine")).when(F.col("rest") >= LEAST, F.col("coarse")).otherwise("all").alias("part")
    )
    parts = tables.table(parts, "parts")
    # rows of no part were all failed by the base rules
    placed = rows.join(parts.drop("n"), "fine").where(judged).select("part", *VECTOR)
    left = parts.where("part = 'all'").agg(F.sum("n").alias("n")).first()["n"] or 0
    few = 0 < left < LEAST
    if few:
        placed = placed.where("part <> 'all'").unionByName(rows.where(judged).select(F.lit("all").alias("part"), *VECTOR))
    spread = [F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 200).alias(v) for v in VECTOR]
    n = len(VECTOR)
    start = placed.groupBy("part").agg(*spread)
    scale = [F.lit(1.0) / (F.pow((F.col(v)[2] - F.col(v)[0]) / 1.35, 2) + floor**2) for v, floor in zip(VECTOR, FLOORS, strict=True)]
    estimate = tables.table(
        start.select(
            "part",
            F.array(*[F.col(v)[1] for v in VECTOR]).alias("center"),
            F.array(*[scale[i] if i == j else F.lit(0.0) for i in range(n) for j in range(n)]).alias("inverse"),
        ),
        "estimate",
    )
    for _ in range(STEPS):
        bin_ = F.floor(F.log2(_distance() + 2.0**-20) * BINS_PER_OCTAVE).cast("int")
        bins = placed.join(estimate, "part").withColumn("bin", bin_).groupBy("part", "bin").agg(*_moments())
        new = bins.groupBy("part").applyInPandas(_concentrate, "part string, center array<double>, inverse array<double>")
        estimate = tables.table(new, "estimate")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    wider = 1 + FEW * F.greatest(2 / F.col("size") - 2 / LEAST, F.lit(0.0))
    known = estimate.join(sizes, "part").select("part", "center", "inverse", (_chi_squared(QUANTILE, n) * wider).alias("cut"))
    known = tables.table(known, "known")
    own = F.lit(True) if not few else F.col("part") != "all"
    return (
        rows.join(parts.drop("n"), "fine", "left")
        .join(known, "part", "left")
        .select(
            "doc_id",
            *STATS,
            "base_failed",
            F.when(judged & own, _distance()).alias("distance"),
            (~F.col("base_failed") & F.coalesce(_distance() <= F.col("cut"), F.lit(True))).alias("kept"),
        )
    )
