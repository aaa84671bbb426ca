"""Every query that has SQL must return the same rows as DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = entry.oracle_sql()
KINDS = {"bigint": {"BIGINT", "INTEGER", "HUGEINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
         "boolean": {"BOOLEAN"}}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v


def _sorted(rows):
    return sorted(([_value(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    position = {c[0]: i for i, c in enumerate(cursor.description)}
    expected = cursor.fetchall()
    assert sorted(position) == names
    for column, kind in df.dtypes:
        assert kinds[column] in KINDS[kind], column
    got = _sorted(df.select(*[f"`{c}`" for c in names]).collect())
    assert got == _sorted([[r[position[c]] for c in names] for r in expected])


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 30


def test_all_queries_are_known():
    assert set(SQL) <= set(entry.queries())
