import duckdb
import pytest

from tesserae.llm import queries
from tests.test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_there_is_a_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]
