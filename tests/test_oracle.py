"""Every registered query of the engine that has SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def spelt(rows, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name, tmp_path):
    """The rows that are collected, and those of a written copy."""
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    df.write.parquet(f"{tmp_path}/copy")
    copy = spark.read.parquet(f"{tmp_path}/copy")
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = spelt([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)
    assert spelt(df.collect(), columns) == want
    assert spelt(copy.collect(), columns) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
