"""Queries that SQL can express, against DuckDB."""

import pytest

from siteglass.llm.checks import ORACLE_SQL
from siteglass.llm.queries import QUERIES
from tests.compare import duck, duck_table, spark_table


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_table(QUERIES[name](spark, sf_dir)) == duck_table(duck(sf_dir), ORACLE_SQL[name])
