"""Every registered query beside its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as driver  # noqa: E402
import check  # noqa: E402

from lexiloom.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(folder):
    return check.oracle(folder)


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    queries, sql = catalog.QUERIES, catalog.ORACLES
    assert set(queries) <= set(driver.queries())
    assert sorted(set(queries) - set(sql)) == []
    assert driver.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, folder, name):
    result = check.compare(spark, con, folder, name)
    assert result.startswith(("ok", "rows-only")), result
