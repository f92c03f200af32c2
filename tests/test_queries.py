"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare, duck
from checks.spark_queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, connection, name):
    assert compare(spark, connection, SF, name) == ""


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 40
