"""Every query runs; those with SQL equal it on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare

from helixframe.plans import registry

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    q, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        assert compare.differences(spark, con, FOLDER, name, q, sql) == ""
    else:
        assert q(spark, FOLDER).count() >= 0
