"""Hand-made change logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import changelog as c_log
from tidemark.functions import coords
from tidemark.operators import changelog as op, copy, verify

LOG = "file string, pos bigint, db string, tbl string, event_type string, k bigint, v string"
W, U, X = op.INSERT, op.UPDATE, op.DELETE


def log(spark, *events):
    return spark.createDataFrame([(f, p, "d", "t", e, k, v) for f, p, e, k, v in events], LOG)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, v string")


def bag(df):
    return sorted(tuple(r) for r in df.collect())


CASES = [
    ("empty log", [], [(1, "a")], [(1, "a")]),
    ("empty table", [("b.1", 4, W, 1, "x")], [], [(1, "x")]),
    ("delete then insert again", [("b.1", 4, X, 1, None), ("b.1", 9, W, 1, "y")], [(1, "a")], [(1, "y")]),
    ("insert then delete", [("b.1", 4, W, 2, "x"), ("b.1", 9, X, 2, None)], [(1, "a")], [(1, "a")]),
    ("update of an absent key", [("b.1", 4, U, 9, "x")], [(1, "a")], [(1, "a")]),
    ("update after delete", [("b.1", 4, X, 1, None), ("b.1", 9, U, 1, "x")], [(1, "a")], []),
    ("insert then update", [("b.1", 4, W, 2, "x"), ("b.1", 9, U, 2, "y")], [], [(2, "y")]),
    ("update to NULL", [("b.1", 4, U, 1, None)], [(1, "a")], [(1, None)]),
    ("NULL key", [("b.1", 4, X, None, None), ("b.1", 5, W, None, "x")], [(1, "a")], [(1, "a")]),
    ("file 10 after file 9", [("b.10", 4, U, 1, "new"), ("b.9", 900, U, 1, "old")], [(1, "a")], [(1, "new")]),
]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("name,events,before,after", CASES, ids=[c[0] for c in CASES])
def test_apply_changes(spark, name, events, before, after, broadcast):
    assert bag(op.apply_changes(table(spark, *before), log(spark, *events), "k", broadcast)) == after


def test_null_key_in_snapshot_stays(spark):
    got = op.apply_changes(table(spark, (None, "n"), (1, "a")), log(spark, ("b.1", 4, X, 1, None)), "k")
    assert [tuple(r) for r in got.collect()] == [(None, "n")]


def test_insert_conflicts(spark):
    events = log(spark, ("b.1", 4, W, 1, "x"), ("b.1", 9, W, 1, "y"), ("b.1", 9, W, 2, "z"), ("b.1", 12, W, 2, "w"))
    snap = table(spark, (1, "a"))
    assert bag(op.apply_inserts(snap, events, "k")) == [(1, "y"), (2, "w")]
    assert bag(op.apply_inserts(snap, events, "k", "keep")) == [(1, "a"), (2, "z")]
    with pytest.raises(ValueError):
        op.apply_inserts(snap, events, "k", "error")
    once = log(spark, ("b.1", 4, W, 3, "x"))
    assert bag(op.apply_inserts(snap, once, "k", "error")) == [(1, "a"), (3, "x")]


def test_bad_transaction_is_dropped_whole(spark):
    events = log(spark, ("b.1", 4, U, 1, "x"), ("b.1", 9, W, 2, None), ("b.1", 12, U, 3, "y"))
    events = events.withColumn("tx", F.when(F.col("k") < 3, 1).otherwise(2))
    bad = (F.col("event_type") == W) & F.col("v").isNull()
    got = op.apply_transactions(table(spark, (1, "a"), (3, "c")), events, "k", "tx", bad)
    assert bag(got) == [(1, "a"), (3, "y")]


def test_diff_leads_to_the_new_snapshot(spark):
    d = "/root/testdata/sf0.001"
    old = c_log.snapshot(spark, d)
    new = op.apply_changes(old, c_log.rows(spark, d), c_log.KEY)
    diff = verify.snapshot_diff(old, new, c_log.KEY, "shop", "orders")
    assert verify.compare_tables(op.apply_changes(old, diff, c_log.KEY), new, c_log.KEY, [(c, c) for c in c_log.COLS]).count() == 0
    assert verify.row_diff(new, new).count() == 0


def test_positions(spark):
    rows = [("mysql-bin.000123", 123), ("binlog.00001", 1), ("binlog", 0), ("binlog.", 0), ("a.b.7", 7), ("a.x", 0)]
    df = spark.createDataFrame(rows, "f string, n bigint")
    assert df.where(coords.file_sequence(F.col("f")) != F.col("n")).count() == 0
    text = spark.createDataFrame([("mysql-bin.000123:456",), ("invalid",), ("a:b:1",), ("f:-3",)], "t string")
    got = [tuple(r) for r in text.select(coords.position_file(F.col("t")), coords.position_offset(F.col("t"))).collect()]
    assert got == [("mysql-bin.000123", 456), (None, None), (None, None), (None, None)]


def test_highest_sequence_per_domain(spark):
    df = spark.createDataFrame([("domain1:1",), ("domain1:2",), ("domain2:5",), ("bad",), (":3",), ("z:0",)], "g string")
    assert op.executed_set(df, "g").first()["gtid_set"] == "domain1:2,domain2:5"


def test_decode_rotation(spark):
    pieces = [F.lit(1700000000), F.lit(4), F.lit(77)]
    head = F.concat(op.to_little_endian(pieces[0], 4), op.to_little_endian(pieces[1], 1), op.to_little_endian(pieces[2], 4), F.unhex(F.lit("00" * 10)))
    data = F.concat(head, op.to_little_endian(F.lit(12345), 8), F.lit("binlog.000007").cast("binary"))
    row = op.decode_events(spark.range(1).select("id", data.alias("data")), "data").first()
    assert (row.event_type, row.unix_ts, row.server_id, row.next_pos, row.next_file) == ("Rotate", 1700000000, 77, 12345, "binlog.000007")


def test_statement_text(spark):
    events = log(spark, ("b.1", 4, W, 1, "it's\\\n"), ("b.1", 5, U, 1, None), ("b.1", 6, X, 1, None))
    got = [r.stmt for r in op.change_statements(events, "k", ["v"]).orderBy("pos").collect()]
    assert got == [
        "INSERT INTO `d`.`t` (`k`, `v`) VALUES ('1', 'it''s\\\\\\n')",
        "UPDATE `d`.`t` SET `v` = NULL WHERE `k` = '1'",
        "DELETE FROM `d`.`t` WHERE `k` = '1'",
    ]


def test_routing(spark):
    events = spark.createDataFrame(
        [("d", "t", W), ("d", "u", W), ("e", "t", U), ("", "", "Rotate"), ("d", "", "Query"), ("d", "h", W), ("d", "t", "Unknown")],
        "db string, tbl string, event_type string",
    )
    kept = [tuple(r) for r in op.route_events(events, "d", "t", "h").collect()]
    assert kept == [("d", "t", W), ("", "", "Rotate"), ("d", "", "Query"), ("d", "h", W)]


def _replay(rows, events):
    """One event after the other, as a table would see them."""
    table = dict(rows)
    for _, _, kind, k, v in sorted(events):
        if kind == W:
            table[k] = v
        elif kind == U and k in table:
            table[k] = v
        elif kind == X:
            table.pop(k, None)
    return sorted(table.items())


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"s{k}") for k in range(60)]
    events = [
        (seq, pos, rng.choice([W, U, X]), rng.randrange(90), f"{seq}.{pos}")
        for seq in (9, 10, 11) for pos in rng.sample(range(1000), 100)
    ]
    made = spark.createDataFrame([(f"b.{s}", p, "d", "t", e, k, v) for s, p, e, k, v in events], LOG).repartition(5)
    for broadcast in (True, False):
        assert bag(op.apply_changes(table(spark, *rows), made, "k", broadcast)) == _replay(rows, events)


def _replay_with_key_changes(rows, events):
    """As ``_replay``; an update is (old key, new key), and rows at one position go before new ones come."""
    table = dict(rows)
    for at in sorted({e[:2] for e in events}):
        rows_here = [e for e in events if e[:2] == at]
        for *_, kind, old, k, v in rows_here:
            if kind == X:
                table.pop(k, None)
            elif kind == U and old != k:
                table.pop(old, None)
        for *_, kind, old, k, v in rows_here:
            if kind == W or kind == U and (old != k or k in table):
                table[k] = v
    return sorted(table.items())


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_with_key_changes_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"s{k}") for k in range(40)]
    events = []
    for seq in (9, 10, 11):
        for pos in rng.sample(range(1000), 60):
            v = f"{seq}.{pos}"
            if rng.random() < 0.3:  # one statement exchanges or shifts several keys
                keys = rng.sample(range(60), 3)
                events += [(seq, pos, U, a, b, f"{v}/{b}") for a, b in zip(keys, keys[1:] + keys[: rng.randrange(2)])]
            else:
                k = rng.randrange(60)
                events.append((seq, pos, rng.choice([W, U, X]), rng.choice([k, k, rng.randrange(60)]), k, v))
    schema = "seq bigint, pos bigint, event_type string, old int, k bigint, v string"
    made = spark.createDataFrame([(s, p, e, None if e == W else o, k, v) for s, p, e, o, k, v in events], schema).repartition(5)
    want = _replay_with_key_changes(rows, events)
    for broadcast in (True, False):
        assert bag(op.apply_changes(table(spark, *rows), made, "k", broadcast, "old")) == want
    parts = [op.compact_changes(part, "k", ["v"], "old") for part in made.randomSplit([1.0, 1.0, 1.0], seed)]
    combined = op.combine_compacted(parts[2].union(parts[0]).union(parts[1]).union(parts[0]), "k")
    assert bag(op.apply_compacted(table(spark, *rows), combined, "k")) == want


def test_key_changes_of_two_columns_and_their_statements(spark):
    schema = "seq bigint, pos bigint, db string, tbl string, event_type string, a_was bigint, b_was string, a bigint, b string, v string"
    rows = [(1, 4, "d", "t", U, 1, "x", 1, "z", "moved"), (1, 8, "d", "t", U, None, "x", 2, "x", "kept"), (1, 9, "d", "t", U, 5, "p", None, "p", "bad")]
    events = spark.createDataFrame(rows, schema)
    old = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (5, "p", "r")], "a bigint, b string, v string")
    got = op.apply_changes(old, events, ["a", "b"], before_key=["a_was", "b_was"])
    assert bag(got) == [(1, "z", "moved"), (2, "x", "kept"), (5, "p", "r")]
    assert bag(op.apply_updates(old, events, ["a", "b"], ["a_was", "b_was"])) == bag(got)
    text = [r.stmt for r in op.change_statements(events.where("a = 1"), ["a", "b"], ["v"], ["a_was", "b_was"]).collect()]
    assert text == ["UPDATE `d`.`t` SET `b` = 'z', `v` = 'moved' WHERE `a` = '1' AND `b` = 'x'"]


def test_key_of_several_columns(spark):
    schema = "a bigint, b string, v string"
    old = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, "x", "r")], schema)
    new = spark.createDataFrame([(1, "x", "p"), (1, "y", None), (3, "x", "n")], schema)
    key = ["a", "b"]
    diff = verify.snapshot_diff(old, new, key, "d", "t")
    assert sorted((r.event_type, r.a, r.b) for r in diff.collect()) == [(X, 2, "x"), (U, 1, "y"), (W, 3, "x")]
    for broadcast in (True, False):
        got = op.apply_changes(old, diff, key, broadcast)
        assert verify.compare_tables(got, new, key, [("v", "v")]).count() == 0
    assert sorted(map(tuple, op.apply_deletes(old, diff, key).collect())) == [(1, "x", "p"), (1, "y", "q")]
    assert sorted(op.latest_change(diff, key).select("a", "b").collect()) == [(1, "y"), (2, "x"), (3, "x")]
    assert [r.stmt for r in op.change_statements(diff.where("a = 2"), key, ["v"]).collect()] == [
        "DELETE FROM `d`.`t` WHERE `a` = '2' AND `b` = 'x'"
    ]
    kept = op.apply_updates(old, diff, key).where("a = 1 AND b = 'y'").first()
    assert kept.v is None
    assert copy.copy_missing(new, old, key).count() == 4 and copy.remaining_rows(new, old, key).first().remaining == 1
    added = op.apply_inserts(old, diff, key, "keep")
    assert added.count() == 4
