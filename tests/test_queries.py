"""Every registered query against its SQL on whole tables (``TEST_SF_DIR``, smallest by default)."""

import os

import pytest

import compare
from icetally.plans.registry import REGISTERED

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", REGISTERED)
def test_query(spark, duck, name):
    query, sql = REGISTERED[name]
    frame = query(spark, SF_DIR)
    if sql is None:
        assert frame.count() > 0
    else:
        assert compare.differences(frame, duck, sql) is None
