"""Every registered query that has SQL against it on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{DATA}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value, 6))
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    expected = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(frame.columns) == sorted(columns)
    got, want = normal(frame.collect(), frame.columns), normal(expected.fetchall(), columns)
    assert want, "the SQL returns nothing, so nothing is checked"
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
