import pytest
from oracle import compare

from cinelake.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_covers_the_table(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200
