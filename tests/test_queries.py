"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from opinara.plans.queries import QUERIES
from tests.check_oracle import compare, connect, registered

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


# The corpus operators have tests of their own, which go with them.
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) is None


def test_every_sql_has_its_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.columns == ["doc_id", "t0", "t1", "t2", "t3", "t4"]
    assert frame.count() == 200
