"""A part of the registered queries against DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracle.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["term_occurrences_docs", "term_hits_by_lang", "terms_by_role", "evidence_pick", "all_outcomes",
          "score_record", "explained_profiles", "ranked_csv_round_trip"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_query_has_sql():
    assert set(entry._queries.queries()) == set(entry._oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["candidate_id", "rank", "score", "reasoning"]
