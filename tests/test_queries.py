"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
