import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, duck(SF), name, SF, queries(), oracle_sql()) is None


def test_entry(spark):
    assert entry(spark).count() > 0
