import pytest
from oracle import differences

from lodestar import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], FOLDER) == ""


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
