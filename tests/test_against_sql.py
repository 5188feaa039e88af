"""Every registered query against its SQL: names, types and all values."""

import os

import pytest

from compare import differences
from thermalcube.checks import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert name in ORACLES
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == ""


def test_entry(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.columns == ["label", "total", "map_class", "colour"]
    assert result.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
