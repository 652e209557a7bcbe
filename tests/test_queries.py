"""Every query with SQL against DuckDB on the smallest tables; the others must give rows of a stable schema."""

import os

import oracle
import pytest

from reportloom.plans import catalogue

SF = os.environ.get("REPORTLOOM_TEST_SF", "/root/testdata/sf0.001")
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert not oracle.compare(spark, SF, name, Q[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, name):
    df = Q[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
