"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks.compare import difference, duck
from checks.registry import ALL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql is not None])
def test_same_rows_as_sql(spark, connection, name):
    build, sql = ALL[name]
    assert difference(build(spark, FOLDER), connection, sql) is None
