"""Each registered query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from vellumine import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = plans.queries(), plans.oracle_sql()


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if number != number else float(f"{number:.10g}")
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name not in SQL:
        assert frame.columns
        return
    cursor = oracle.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    expected = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == expected


def test_flagship_is_registered():
    assert plans.FLAGSHIP in QUERIES and plans.FLAGSHIP in SQL
