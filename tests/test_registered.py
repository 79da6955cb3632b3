"""Registered queries against their SQL on the smallest tables."""

import math
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path(entry.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def shown(value):
    if isinstance(value, (float, Decimal)) and not isinstance(value, bool):
        return "nan" if math.isnan(value) else format(float(value) + 0.0, ".6f")
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


def test_every_query_has_sql_or_a_reason():
    # The end-to-end run is checked by parts; what is learned step by step by tests of their own.
    without = {q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q)} - set(entry.oracle_sql())
    assert without == {"prepared_splits", "learn_unigram", "cbow_vectors", "select_responses_indexed"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    frame = entry.queries()[name](spark, str(TABLES))
    cursor = sql.execute(entry.oracle_sql()[name])
    wanted = table([c[0] for c in cursor.description], cursor.fetchall())
    found = table(frame.columns, [tuple(r) for r in frame.collect()])
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
    assert found[1]


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["id", "sender", "tweets", "response", "author_id"]
    assert frame.count() == 2101
