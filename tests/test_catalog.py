"""Every query of the catalogue against DuckDB on the smallest tables; those without SQL must run and give rows."""

import os

import duckdb
import pytest

from quillrank.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows with columns in the order of their names, in an order of their own."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if isinstance(v, float) else v
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_is_what_sql_says(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names, mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    want = duck.sql(ORACLES[name])
    expected, theirs = rows_of(want.columns, want.fetchall())
    assert names == expected
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() > 0
