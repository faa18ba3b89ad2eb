"""Every query against its SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tidemark import catalog
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.load()

# The names of the operator inventory.
INVENTORY = """
scan_key_range read_change_log append_hints progress_json
column_profile key_check shared_key duplicate_key_rows orphan_rows row_count_exact row_count_estimate key_range
next_key chunk_boundaries copy_chunk assign_chunks row_copy copy_missing remaining_rows copy_progress
add_column drop_column modify_column change_column rename_column alter_table add_unique_key cast_audit
add_auto_increment schema_diff
route_events order_events events_between latest_change apply_inserts apply_updates apply_partial_updates
apply_deletes apply_changes apply_transactions changed_cells change_statements event_counts decode_events
current_file locate_events executed_set pending_events
latest_hints latest_state classify_hints resume_point heartbeat_gaps heartbeat_lag
throttle_decision max_lag throttle_periods backoff query_throttle active_sessions rate_limit
table_checksum chunk_checksums compare_tables snapshot_diff publish migrate_table
stream_apply stream_latest stream_event_counts stream_rate_limit stream_throttle stream_heartbeat_monitor stream_dedupe
text_columns split_join_rows parse_numbers escape_columns wildcard_match statement_audit ddl_operations utf8_audit
endpoint_inventory version_rank time_columns duration_text
""".split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_inventory_is_complete():
    assert set(INVENTORY) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
