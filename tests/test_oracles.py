"""Every registered query against its SQL twin, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert entry.FLAGSHIP in ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3
