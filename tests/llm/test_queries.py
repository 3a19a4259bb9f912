"""Every registered query of the subpackage against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from veripaper.llm.queries import ORACLES, QUERIES

from ..compare import compare

#: Without SQL: these have tests of their own.
WITHOUT_SQL = {"op2_language_id", "op8_packing", "op9_sentencepiece", "op12_quality_classifier", "pipeline"}


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, folder, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) is None
