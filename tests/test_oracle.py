"""Every registered query against its SQL on the driver's tables."""

import pytest

from tests.compare import differences, duck
from webtally.plans.oracle import ORACLES
from webtally.plans.registry import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) == 61


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, ORACLES[name]) == []


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
