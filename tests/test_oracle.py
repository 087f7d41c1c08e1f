"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lexweave import plans
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(plans.oracles()) == set(plans.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "kind", "canonical_ref", "score", "phrase", "rank"]
