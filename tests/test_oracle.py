"""Every registered query against its SQL in another engine."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


def test_every_query_of_the_tables_has_an_oracle():
    learned = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") and name[2].isdigit() for name in learned)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["month", "orders", "revenue"]
    assert 0 < result.count() <= 80


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query(spark, oracle, name):
    assert compare(spark, oracle, SMALL, name) is None
