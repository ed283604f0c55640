"""Queries over whole texts and all rows equal their DuckDB text."""

import pytest
from test_entry import test_equals_sql as equals_sql

NAMES = ["c18_memory_top_k", "c18_pivot_top_k", "c03_rules", "c16_learned_prefix", "i25_learn_prefix", "m07_edit_revert", "a21_bucket_upsert", "a01_document_files", "a14_xlsx_roundtrip", "e03_block_scan", "w02_sessions", "w03_distinct_events", "c15_stream_names", "m04_agent_turns"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_equals_sql(spark, name):
    equals_sql(spark, name)
