"""Every registered query against its oracle, at the smallest scale."""

from __future__ import annotations

import os

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as contract

SF_DIR = os.environ.get("VEILWORK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, oracle, name):
    df = contract.queries()[name](spark, SF_DIR)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        matches, message = compare(df, oracle, sql)
        assert matches, message
