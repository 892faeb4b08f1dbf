import pytest

import __spark_entry__
from tarnlake.registry import DIALECT_SQL, ORACLE_SQL, QUERIES, engine
from tests.conftest import SF
from tests.oracle import connect, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_oracle(spark, con, name):
    names, want = oracle_rows(con, ORACLE_SQL[name])
    got_names, got = spark_rows(QUERIES[name](spark, SF))
    assert got_names == names and got == want


@pytest.mark.parametrize("name", [n for n, q in DIALECT_SQL.items() if "ORDER BY" in q])
def test_rows_come_in_order(spark, con, name):
    """Where keys are total, the order of rows is part of the result."""
    first, again = ([tuple(r) for r in engine(spark, SF).sql(DIALECT_SQL[name]).collect()] for _ in range(2))
    assert first == again


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("sort_")])
def test_whole_tables_come_in_order(spark, con, name):
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert [tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()] == found.fetchall()
