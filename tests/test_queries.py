"""Every query of the library runs, and gives what its SQL gives."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


#: Queries that may rightly find nothing in small tables.
EMPTY = {"corner_scores", "saddle_corners", "stream_windows", "keyframe_policy"}


def normal(rows, columns):
    import math

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(repr(tuple(cell(r[c]) for c in columns)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert normal([r.asDict() for r in df.collect()], columns) == normal([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_the_others_run(spark, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    assert rows or name in EMPTY
    assert all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
