import pytest
from oracle import compare

from cinelake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
