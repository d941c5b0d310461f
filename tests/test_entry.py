"""Every query against its SQL, on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for file in os.listdir(FOLDER):
        base.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return base


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    result = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(str, (tuple(plain(r[c]) for c in columns) for r in got.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
