import pytest

from tarnlake.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_against_oracle(spark, name):
    names, want = oracle_rows(connect(SF), ORACLE_SQL[name])
    got_names, got = spark_rows(QUERIES[name](spark, SF))
    assert got_names == names and got == want
