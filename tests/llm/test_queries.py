import os

import pytest

import compare
from swayrank.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert ": ok" in compare.compare(spark, compare.connect(FOLDER), FOLDER, name)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
