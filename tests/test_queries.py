"""Every registered query with a SQL check, at the smallest scale; the rest must run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect
from panelloom.plans import load_registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(load_registry()))
def test_query(spark, duck, name):
    line = compare(spark, duck, load_registry()[name], SF)
    assert not line.startswith("FAIL"), line
