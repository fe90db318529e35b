"""Every registered query of the engine equals its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tabclone import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, str)) or v is None:
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "nan" if math.isnan(v) else f"{float(v):.5f}".replace("-0.00000", "0.00000") if not float(v).is_integer() else str(int(v))


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([plain(r[i]) for i in order] for r in found)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_without_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "llm", None)
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.SQL)
