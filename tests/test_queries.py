"""Every registered query against its SQL, and the driver contract itself."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from fieldcast.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
# Three or four pairs per series at the smallest scale make residual ranks a matter of rounding.
# No summer day is complete there, and too few cells are left by the mask.
NEEDS_MORE_DATA = {"partial_spearman", "base_rate_forecast", "base_rate_folds", "mask_cells"}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_against_sql(spark, con, name):
    sf, tables = (LARGER, connect(LARGER)) if name in NEEDS_MORE_DATA else (SF, con)
    verdict = compare(spark, tables, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    if verdict == "no rows":  # the smallest tables leave nothing to compare
        verdict = compare(spark, connect(LARGER), name, entry.queries()[name], entry.oracle_sql()[name], LARGER)
    assert verdict == ""


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(entry.oracle_sql())))
def test_without_sql_as_registered(spark, name):
    """Queries that no SQL repeats run as they are registered, and have rows."""
    assert REGISTRY[name](spark, LARGER).count() > 0
