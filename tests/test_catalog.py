"""A few registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["activity_map", "consistency_map", "recall_compounds", "tiers", "select_best_average", "key_digest",
                                  "curated_wells", "curation_steps"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry
    from compare import compare, duck

    ok, note = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note
