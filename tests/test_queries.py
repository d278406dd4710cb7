"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tesserae import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pagerank"}  # top_symbols runs the same iterations


def rows(frame):
    names = sorted(frame.columns)
    values = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    return names, sorted(map(repr, values))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in queries.REGISTERED if n not in SLOW])
def test_query_matches_its_sql(spark, duck, name):
    assert rows(queries.REGISTERED[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(queries.REGISTERED) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["symbol", "depth"]
    assert set(e.oracle_sql()) <= set(e.queries())
