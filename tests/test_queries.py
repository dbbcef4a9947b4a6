import os

import pytest

import __spark_entry__ as entry
from kumiko.plans.catalogue import ORACLES, QUERIES
from oracle import compare

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], ROOT) is None


def test_contract():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
