"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from veripaper.plans import all_oracles, all_queries

from .compare import compare

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, folder, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["paper_id", "similar_paper_id", "similarity", "status", "validation_notes"]
    assert found.count() > 0
