"""Every query with SQL agrees with it on the smallest tables; the others give rows."""

from __future__ import annotations

import os

import pytest

from inkwell.plans import catalog, collected, planned  # noqa: F401 - registers its queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
