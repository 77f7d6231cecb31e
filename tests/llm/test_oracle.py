"""The text queries that have SQL twins against DuckDB."""

import pytest
from area_trends.llm import queries
from compare import duckdb_connection, duckdb_table, spark_table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, sf, name):
    found = spark_table(queries.QUERIES[name](spark, sf))
    assert found == duckdb_table(duckdb_connection(sf), queries.ORACLE[name])
