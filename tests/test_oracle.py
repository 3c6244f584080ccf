"""Every query with a DuckDB statement gives the same rows and columns at sf0.001."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from riskweave.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(rows):
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_oracle(spark, db, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.sql(plans.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    got = _rows([tuple(r[c] for c in columns) for r in df.collect()])
    assert got == _rows(db.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.oracle_sql()[name]})').fetchall())


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(plans.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3


def test_every_query_without_oracle_runs(spark):
    for name in set(plans.queries()) - set(plans.oracle_sql()):
        assert plans.queries()[name](spark, SF).count() > 0
