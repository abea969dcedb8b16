"""Every SQL-stated query against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for file in Path(request.config.getoption("--sf")).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in records)


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, request, name):
    mine = QUERIES[name](spark, request.config.getoption("--sf"))
    theirs = duck.execute(ORACLE[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows(mine.columns, mine.collect()) == rows(columns, theirs.fetchall())
