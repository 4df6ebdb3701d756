"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    problem, _, _, _ = compare(spark, con, name, SF)
    assert problem in (None, "no rows")


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_all_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
