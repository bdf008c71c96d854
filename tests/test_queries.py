"""Every registered query against its check SQL, at the smallest scale."""

import pytest
from compare import compare, duck

from linkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog()))
def test_query_matches_check(spark, con, name):
    ok, rows, _, why = compare(spark, con, catalog()[name], SF)
    assert ok, why


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
