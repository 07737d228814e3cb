"""Every registered query equals its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from catalog import QUERIES, SQL
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, name)
    assert verdict == "ok", verdict


def test_queries_are_registered():
    assert QUERIES.keys() <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["l_returnflag", "l_linestatus", "l_extendedprice"] and out.count() == 3
