"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import compare

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def names():
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__
    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import __spark_entry__ as entry
    _, problems = compare.differences(spark, con, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert not problems


def test_entry(spark):
    import __spark_entry__ as entry
    assert not entry.entry(spark).isEmpty()
