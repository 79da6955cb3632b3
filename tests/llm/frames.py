"""Small tables for the tests, and the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars int"

#: Own column names that operators use inside.
CLASHING = ("score", "size", "node", "key", "label", "hash", "pattern", "part", "comp", "digest", "bucket", "held")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + k % 6)) for k in (rng.randrange(vocabulary) for _ in range(n)))


def documents(spark, texts, source="s", lang="en"):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    plain = words(rng, 120)
    rows = [
        (None, None, None, None, None),
        (None, "text of a null id", "en", "a", 17),
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, long, "en", "a", len(long)),
        (5, plain, "de", "b", len(plain)),
        (5, plain, "de", "b", len(plain)),
        (6, plain, "de", "b", len(plain)),
        (7, "é ü ß @ + :// 1 1.2.3 ===", "fr", "", 5),
    ]
    fields = T._parse_datatype_string(DOCS).fields + [T.StructField(c, T.StringType()) for c in CLASHING]
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], T.StructType(fields))


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def labels(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")
