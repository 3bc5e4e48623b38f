"""Every query of the engine against its oracle on the smallest tables."""

import pytest
from oracle import connect, same

from quarrylight.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    same(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name])


def test_lowess_query_runs(spark):
    rows = catalog.QUERIES["outliers_lowess_long"](spark, FOLDER).collect()
    assert rows and all(abs(r.value - r.trend_value - r.residual) < 1e-3 for r in rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
