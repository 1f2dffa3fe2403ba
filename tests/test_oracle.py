"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from stagelens.plans.registry import QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
