"""Registered queries against their DuckDB texts at the smallest scale."""

import os

import pytest
from compare import check, connection

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One per operator family keeps the suite quick; WINNOW_ALL=1 runs every query, as tests/compare.py does at a larger size.
CHOSEN = [
    "catalog_page_score", "catalog_deep_page", "snapshot_diff", "missing_rows", "payload_projection", "sidecar_plan",
    "decision_import_check", "bulk_adoption", "variant_changes", "undo_report", "user_sessions", "duplicate_groups",
    "scene_chunks", "suppressed_boxes", "search_batch", "score_components", "selection_plan", "box_matches",
    "preference_report", "nearest_rank", "corpus_statistics", "streamed_decisions", "streamed_requests", "streamed_guard",
    "streamed_progress", "grouped_project", "scene_corrections", "surviving_analyses", "box_overlaps",
]
if os.environ.get("WINNOW_ALL"):
    CHOSEN = sorted(ORACLES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(CHOSEN) <= set(ORACLES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, name):
    verdict, _ = check(spark, connection(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER)
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() > 0
