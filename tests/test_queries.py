"""Every query of the catalog against DuckDB."""

from __future__ import annotations

import pytest
from compare import rows, same
from conftest import SF

from quarry.queries import catalog

CATALOG = catalog()
#: Empty by its meaning, and empty for want of rows in the smallest fixture.
EMPTY = {"subq_not_in_nulls", "tpch_q22"}


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.oracle is not None])
def test_matches_duckdb(spark, duck, name):
    got = CATALOG[name].build(spark, SF).toPandas()
    want = duck.sql(CATALOG[name].oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows(got), rows(want))
    if name not in EMPTY:
        assert len(got), "no rows"
        assert got.notna().any(axis=None), "nothing but nulls"


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.oracle is None])
def test_runs(spark, name):
    assert CATALOG[name].build(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
