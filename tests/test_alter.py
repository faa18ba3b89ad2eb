"""Schema changes and key checks on hand-made rows."""

import pytest

from tidemark.operators import alter as op
from tidemark.operators.alter import AddColumn, ChangeColumn, DropColumn, ModifyColumn, RenameColumn, RenameTable
from tidemark.operators import copy, inspect
from tidemark.operators.inspect import KeySpec


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", "10"), (2, None, "x"), (2, "b", None)], "id bigint, name string, n string")


def test_errors(t):
    for ops in ([], [RenameTable("u")], [DropColumn("nope")], [AddColumn("ID", "int")], [RenameColumn("name", "n")],
                [AddColumn("c", "int", after="nope")], [AddColumn("c", "int", nullable=False)]):
        with pytest.raises(op.AlterError):
            op.alter_table(t, ops)


def test_order_and_names(t):
    got = op.alter_table(t, [
        AddColumn("c", "int", default=5, first=True), ModifyColumn("id", "int", after="N"),
        ChangeColumn("NAME", "label", "varchar(5)"), AddColumn("z", "json"),
    ])
    assert got.columns == ["c", "label", "n", "id", "z"]
    assert dict(got.dtypes)["id"] == "int"


def test_pairs(t):
    pairs = op.column_pairs(t, [DropColumn("n"), AddColumn("c", "int"), RenameColumn("name", "label"), ModifyColumn("id", "int")])
    assert pairs.shared == [("id", "id"), ("name", "label")]
    assert (pairs.dropped, pairs.added, pairs.modified) == (["n"], ["c"], ["id"])


def test_types():
    want = {
        "INT": "int", "int unsigned": "bigint", "BIGINT UNSIGNED": "decimal(20,0)", "VARCHAR(20)": "string",
        "decimal(10, 2)": "decimal(10,2)", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp", "POINT": "string",
        "YEAR": "smallint", "BOOL": "boolean", "BLOB": "binary", "TIME": "string", "ENUM('a')": "string",
    }
    assert {k: op.spark_type(k) for k in want} == want


def test_audit(t):
    rows = {tuple(r) for r in op.cast_audit(t, [ModifyColumn("n", "int", nullable=False), ModifyColumn("name", "varchar(0)", values=("a",))]).collect()}
    assert rows == {("n", "cast", 1), ("n", "null", 1), ("name", "cast", 0), ("name", "length", 2), ("name", "value", 1)}


def test_unique_key(t):
    assert op.add_unique_key(t, ["id"]).count() == 2
    assert op.add_unique_key(t, ["name"]).count() == 0
    assert op.add_unique_key(t, ["name"], primary=True).count() == 1
    op.require_unique(t, ["name"])
    with pytest.raises(op.AlterError):
        op.require_unique(t, ["name"], primary=True)


def test_key_check_and_shared_key(t):
    row = inspect.key_check(t, [KeySpec("k", ("name", "n"))]).first()
    assert (row.rows, row.distinct_keys, row.duplicates, row.null_rows, row.usable) == (3, 1, 0, 2, False)
    assert inspect.shared_key(t, t, [KeySpec("k", ("id",))]).count() == 0
    assert inspect.shared_key(t, t.drop("n"), [KeySpec("k", ("n",))]).count() == 0


def test_empty_table(t):
    none = t.where("id > 9")
    assert tuple(inspect.key_range(none, "id").first()) == ("0", "0")
    assert copy.chunk_boundaries(none, "id", 10).count() == 0
    assert copy.chunk_boundaries(none, "id", 10, one_task=False).count() == 0
    assert op.add_auto_increment(none, ["id"], one_task=False).count() == 0
    assert copy.next_key(t, "id", 2).count() == 0
    assert tuple(copy.remaining_rows(none, none, "id").first()) == (0, 0, 0.0)
    assert inspect.key_check(none, [KeySpec("k", ("id",))]).first().usable


def test_copy_missing_is_repeatable(t):
    shadow = t.where("n = 'x'")
    once = copy.copy_missing(t.dropDuplicates(["id"]), shadow, "id")
    assert copy.copy_missing(t.dropDuplicates(["id"]), once, "id").count() == once.count() == 2


def test_chunks_hold_whole_keys(spark):
    df = spark.createDataFrame([(1,)] * 7 + [(2,), (3,), (4,)], "k bigint")
    got = sorted(tuple(r) for r in copy.chunk_boundaries(df, "k", 3, one_task=False).select("lo", "hi", "rows").collect())
    assert got == [(1, 1, 7), (1, 3, 2), (3, 4, 1)]
    ids = copy.assign_chunks(df, copy.chunk_boundaries(df, "k", 3), "k").groupBy("chunk_id").count()
    assert sorted(r["count"] for r in ids.collect()) == [1, 2, 7]


def test_keys_outside_all_chunks(spark):
    bounds = spark.createDataFrame([(0, 10, 20, 5), (1, 20, 30, 5)], "chunk_id bigint, lo bigint, hi bigint, rows bigint")
    df = spark.createDataFrame([(9,), (10,), (20,), (21,), (30,), (31,)], "k bigint")
    want = [(9, None), (10, 0), (20, 0), (21, 1), (30, 1), (31, None)]
    for lookup in (100, 1):
        assert sorted(tuple(r) for r in copy.assign_chunks(df, bounds, "k", lookup).collect()) == want


def test_scan_without_both_ends(t):
    assert copy.scan_key_range(t, "id", lo=1).count() == 3
    assert copy.scan_key_range(t, "id", 1, 2).count() == 2
