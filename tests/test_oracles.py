"""Registered queries against their DuckDB oracles on the smallest tables.

A spread of queries runs by default; TIDEMARK_ORACLES=all runs every one.
"""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from check import duck, table  # noqa: E402

SF = "/root/testdata/sf0.001"
SPREAD = (
    "w02_landing_time", "w05_recent_experience", "w08_area_history", "j01_revert_stats", "m02_split_labels", "a02_any_attempt_label",
    "a23_rule_score", "a14_a15_ranking_per_group", "a20_threshold_search", "j15_forward_asof_outcome", "f04_revert_unwrap", "f06_clean_body",
    "u04_line_pairing", "p01_change_types", "m12_tfidf", "t02_similar_top_k", "j11_reverse_reach", "a25_coverage_counts", "j02_incidents",
    "j22_ground_truth", "t06_finding_posting", "x02_polling_upsert", "s10_change_sets_round_trip",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDEMARK_ORACLES") == "all" else SPREAD


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    frame = entry.queries()[name](spark, SF)
    cursor = duck(SF).execute(entry.oracle_sql()[name])
    want = table([item[0] for item in cursor.description], cursor.fetchall())
    assert table(frame.columns, [tuple(row) for row in frame.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
