"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from compare import difference
from tierdown.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    problem = difference(spark, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].pruned == rows[0].backed_up > 0
