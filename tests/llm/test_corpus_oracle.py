"""The corpus queries that SQL can express give the rows of their DuckDB statements."""

from __future__ import annotations

import duckdb
import pytest

from riskweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(tuple(r[c] for c in expected.columns) for r in got.collect()) == sorted(expected.fetchall())
