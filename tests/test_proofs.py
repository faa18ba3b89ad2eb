"""Checksums, comparisons and casts on rows that used to look alike."""

import pytest

from tidemark.operators import alter, changelog, columns, copy, flow, verify
from tidemark.operators.alter import ModifyColumn, RenameColumn
from tidemark.plans.ddl import alter_specs


def test_unlike_rows_have_unlike_checksums(spark):
    def sums(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return [verify.table_checksum(df, fast=f).first()["checksum"] for f in (False, True)]

    for left, right in (
        ([(None, "x")], [("\\N", "x")]), ([(None, "x")], [("N", "x")]), ([("p\x1fq", "r")], [("p", "q\x1fr")]), ([("1:a", "")], [("", "1:a")]),
    ):
        assert all(a != b for a, b in zip(sums(left), sums(right)))
    assert sums([("a", "b"), ("c", "d")]) == sums([("c", "d"), ("a", "b")])
    assert sums([]) == ["0", "0"]


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "k bigint, v bigint")
    assert verify.compare_tables(df, df, "k", [("v", "v")]).count() == 0
    assert verify.snapshot_diff(df, df, "k", "d", "t").count() == 0
    other = spark.createDataFrame([(None, 9), (2, 2)], df.schema)
    assert [(r.k, r.status) for r in verify.compare_tables(df, other, "k", [("v", "v")]).collect()] == [(None, "different")]


def test_part_of_a_chunk_list_is_read_alike_on_both_paths(spark):
    keys = spark.createDataFrame([(i,) for i in range(31)], "k bigint")
    part = spark.createDataFrame([(1, 10, 20, 10), (2, 20, 30, 10)], "chunk_id bigint, lo bigint, hi bigint, rows bigint")
    got = [{r.k: r.chunk_id for r in copy.assign_chunks(keys, part, "k", n).collect()} for n in (100, 1)]
    assert got[0] == got[1] == {i: None if i <= 10 else 1 if i <= 20 else 2 for i in range(31)}


def test_types(spark):
    want = {"LONGBLOB": "binary", "VARBINARY(16)": "binary", "NUMERIC(10,2)": "decimal(10,2)", "REAL": "double", "DEC(8, 2)": "decimal(8,2)"}
    assert {k: alter.spark_type(k) for k in want} == want
    with pytest.raises(alter.AlterError):
        alter.spark_type("GEOMETRYX")


def test_lossy_and_renamed_casts_are_audited(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (None,)], "v double")
    for ops in ([ModifyColumn("v", "int")], [RenameColumn("v", "w"), ModifyColumn("w", "int")]):
        assert [(r.column_name, r.reason, r.bad_rows) for r in alter.cast_audit(df, ops).collect()] == [("v", "cast", 1)]
    fine = spark.createDataFrame([("1.239",)], "v string").selectExpr("CAST(v AS decimal(12,3)) AS v")
    assert alter.cast_audit(fine, [ModifyColumn("v", "decimal(12,2)")]).first().bad_rows == 1


def test_log_files_of_the_same_number_and_malformed_ids(spark):
    log = spark.createDataFrame([("a.1", 4), ("a.1", 9), ("b.1", 4), ("b.1", 9)], "file string, pos bigint")
    assert changelog.locate_events(log, changelog.log_files(log)).count() == 4
    ids = spark.createDataFrame([("d:5",), ("d:9",), ("broken",), (None,)], "gtid string")
    done = spark.createDataFrame([("d", 5)], "domain string, max_seq bigint")
    assert sorted(str(r.gtid) for r in changelog.pending_events(ids, "gtid", done).collect()) == ["None", "broken", "d:9"]


def test_query_throttle_takes_plain_digits_only(spark):
    metrics = spark.range(1).selectExpr("id AS tick", "current_timestamp() AS ts", "'r' AS replica")
    assert flow.query_throttle(spark, "SELECT '²'", metrics).first()["throttled"] is False


def test_quoted_parts_of_a_statement_stay_whole(spark):
    text = "ALTER TABLE t ADD COLUMN a VARCHAR(9) DEFAULT 'a,b', MODIFY b VARCHAR(9)   DEFAULT 'a  b', ADD c CHAR(4) DEFAULT 'it''s, (x'"
    rows = columns.ddl_operations(spark.createDataFrame([(text,)], "stmt string"), "stmt", []).orderBy("op_no").collect()
    assert [(r.kind, r.name, r.definition) for r in rows] == [
        ("AddColumn", "a", "VARCHAR(9) DEFAULT 'a,b'"), ("ModifyColumn", "b", "VARCHAR(9) DEFAULT 'a  b'"),
        ("AddColumn", "c", "CHAR(4) DEFAULT 'it''s, (x'"),
    ]
    assert [op.default for op in alter_specs(spark, text) if hasattr(op, "default")] == ["a,b", "it's, (x"]


def test_a_rotation_in_an_oddly_named_column(spark):
    body = bytes([0] * 4 + [4] + [1, 0, 0, 0] + [0] * 10) + (77).to_bytes(8, "little") + b"binlog.9"
    df = spark.createDataFrame([(bytearray(body),)], "`raw data` binary")
    row = changelog.decode_events(df, "raw data").first()
    assert (row.event_type, row.next_pos, row.next_file) == ("Rotate", 77, "binlog.9")
