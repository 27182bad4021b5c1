"""Every registered query against independent SQL on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from conftest import TESTDATA

from paddock.plans import oracle, registry


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(TESTDATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normal(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


def test_all_queries_have_sql():
    assert set(registry.queries()) == set(oracle.statements())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, TESTDATA)
    cursor = duck.execute(oracle.statements()[name])
    columns = [c[0] for c in cursor.description]
    expected = normal(cursor.fetchall())
    assert sorted(found.columns) == sorted(columns)
    assert normal(tuple(r) for r in found.select(*columns).collect()) == expected
    assert expected
