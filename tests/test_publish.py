"""Publishing, migration failures and hint tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alter
from tidemark.operators.alter import AddColumn, ModifyColumn
from tidemark.operators.inspect import KeySpec
from tidemark.plans.ddl import alter_specs
from tidemark.plans.migrate import MigrationError, migrate_table
from tidemark.sources import sinks

LOG = "seq bigint, pos bigint, event_type string, k bigint, v string"


def test_a_failed_version_leaves_the_old_one(spark):
    old = spark.createDataFrame([(1,)], "k bigint")
    sinks.publish(old, "pub_a", 1)

    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.publish(spark.createDataFrame([(2,)], "k bigint"), "pub_a", 2, check=refuse)
    assert [r.k for r in spark.table("pub_a").collect()] == [1]
    assert not spark.catalog.tableExists("pub_a_v2")


def test_switch_and_drop(spark):
    sinks.publish(spark.createDataFrame([(1,)], "k bigint"), "pub_b", 1)
    sinks.publish(spark.createDataFrame([(2, "x")], "k bigint, v string"), "pub_b", 2, drop_old=True)
    assert [tuple(r) for r in spark.table("pub_b").collect()] == [(2, "x")]
    assert not spark.catalog.tableExists("pub_b_v1")


def test_migration(spark):
    snap = spark.createDataFrame([(1, "10"), (2, "20")], "k bigint, v string")
    log = spark.createDataFrame([(1, 4, "UpdateRows", 1, "11"), (1, 9, "WriteRows", 3, "30")], LOG)
    ops = [ModifyColumn("v", "int"), AddColumn("n", "varchar(4)", default="-")]
    got = migrate_table(snap, ops, log, [KeySpec("pk", ("k",), True)], "mig_a")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 11, "-"), (2, 20, "-"), (3, 30, "-")]
    for bad_snap, keys in ((snap.union(snap), ("k",)), (spark.createDataFrame([(1, "x")], snap.schema), ("k",))):
        with pytest.raises(MigrationError):
            migrate_table(bad_snap, ops, log, [KeySpec("pk", keys, True)], "mig_b")
    assert not spark.catalog.tableExists("mig_b")


def test_hint_ids_rise(spark, tmp_path):
    path = str(tmp_path / "hints")
    for i in range(2):
        rows = spark.createDataFrame([(1, "heartbeat", "5"), (2, "completed", "")], "o int, hint string, value string")
        sinks.append_hints(rows, path, ["o"], exists=i > 0)
    got = sinks.read_hints(spark, path).orderBy("id").collect()
    assert [(r.id, r.hint) for r in got] == [(1, "heartbeat"), (2, "completed"), (3, "heartbeat"), (4, "completed")]
    assert all(r.ts is not None for r in got)


def test_alter_text(spark):
    got = alter_specs(spark, """ALTER TABLE shop.t ADD COLUMN `c` INT UNSIGNED NOT NULL DEFAULT 7 FIRST, DROP d,
        CHANGE e f ENUM('x', 'y'), MODIFY g DECIMAL(10, 2) NOT NULL AFTER f, RENAME COLUMN h TO i, ADD UNIQUE KEY u (c, f)""")
    assert got == [
        AddColumn("c", "INT UNSIGNED", "7", False, True), alter.DropColumn("d"),
        alter.ChangeColumn("e", "f", "ENUM('x', 'y')", values=("x", "y")),
        ModifyColumn("g", "DECIMAL(10, 2)", False, after="f"), alter.RenameColumn("h", "i"),
        alter.TableOption("AddUniqueKey", "u", ("c", "f")),
    ]
    t = spark.createDataFrame([(1, "x", "1.5", 2)], "d int, e string, g string, h int")
    out = alter.alter_table(t, got)
    assert out.columns == ["c", "f", "g", "i"] and out.first()["c"] == 7
    with pytest.raises(alter.AlterError):
        alter.alter_table(t, alter_specs(spark, "ALTER TABLE t RENAME TO u"))
    with pytest.raises(alter.AlterError):
        alter_specs(spark, "SELECT 1")


def test_migration_by_a_key_of_two_columns(spark):
    snap = spark.createDataFrame([("10", 1, "a"), ("20", 1, "b")], "v string, k bigint, s string")
    log = spark.createDataFrame([(1, 4, "UpdateRows", "11", 1, "a"), (1, 9, "DeleteRows", None, 1, "b")], "seq bigint, pos bigint, event_type string, v string, k bigint, s string")
    got = migrate_table(snap, [AddColumn("n", "int", first=True)], log, [KeySpec("pk", ("k", "s"), True)], "mig_c")
    assert [tuple(r) for r in got.collect()] == [(None, "11", 1, "a")]


def test_indexed_table_joins_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("idx_a", "idx_b"):
            alter.write_indexed(spark.range(100).select(F.col("id").alias("k"), F.lit(name).alias(name)), ["k"], name, 4)
        joined = spark.table("idx_a").join(spark.table("idx_b"), "k")
        assert joined.count() == 100
        assert "Exchange hashpartitioning(k" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_rerun_with_a_failing_check_keeps_the_live_version(spark, tmp_path):
    def refuse(_):
        raise RuntimeError("no")

    for path in (None, str(tmp_path / "live")):
        name = "pub_c" if path is None else "pub_d"
        sinks.publish(spark.createDataFrame([(1,)], "k bigint"), name, path=path)
        with pytest.raises(RuntimeError):
            sinks.publish(spark.createDataFrame([(2,)], "k bigint"), name, path=path, check=refuse)
        with pytest.raises(ValueError):
            sinks.publish(spark.createDataFrame([(3,)], "k bigint"), name, 1, path=path)
        assert [r.k for r in spark.table(name).collect()] == [1]
        sinks.publish(spark.createDataFrame([(4,)], "k bigint"), name, path=path, drop_old=True)
        assert [r.k for r in spark.table(name).collect()] == [4]
        assert sinks.versions(spark, name) == [2]
    assert [p.name for p in (tmp_path / "live").iterdir()] == ["v2"]


@pytest.mark.parametrize("outside", [False, True])
def test_two_publishers_at_once(spark, tmp_path, monkeypatch, outside):
    """Neither sees the other's version before it claims its own; both end readable."""
    name, path = ("race_a", None) if not outside else ("race_b", str(tmp_path / "race"))
    monkeypatch.setattr(sinks, "versions", lambda *_: [])
    sinks.publish(spark.createDataFrame([(1,)], "k bigint"), name, path=path)
    seen = []

    def other_publishes(_):
        if not seen:
            seen.append(sinks.publish(spark.createDataFrame([(3,)], "k bigint"), name, path=path).collect())

    sinks.publish(spark.createDataFrame([(2,)], "k bigint"), name, path=path, check=other_publishes)
    assert [r.k for r in seen[0]] == [3] and [r.k for r in spark.table(name).collect()] == [2]
    assert [[r.k for r in spark.table(f"{name}_v{v}").collect()] for v in (1, 2, 3)] == [[1], [2], [3]]

    def refuse(_):
        raise RuntimeError("no")

    for version in (None, 2):  # a failed or refused claim takes nobody's table with it
        with pytest.raises((RuntimeError, ValueError)):
            sinks.publish(spark.createDataFrame([(9,)], "k bigint"), name, version, path=path, check=refuse)
    assert [r.k for r in spark.table(name).collect()] == [2] and sinks.live_version(spark, name) == 2
    sinks.publish(spark.createDataFrame([(4,)], "k bigint"), name, path=path, drop_old=True)
    assert [r.k for r in spark.table(name).collect()] == [4] and not spark.catalog.tableExists(f"{name}_v2")
    assert [r.k for r in spark.table(f"{name}_v3").collect()] == [3]


def test_a_left_folder_is_not_adopted(spark, tmp_path):
    spark.createDataFrame([(7,)], "k bigint").write.parquet(str(tmp_path / "left" / "v1"))
    got = sinks.publish(spark.createDataFrame([(8,)], "k bigint"), "left_a", path=str(tmp_path / "left"))
    assert [r.k for r in got.collect()] == [8] and sinks.live_version(spark, "left_a") == 2


def test_migration_with_key_changes(spark):
    snap = spark.createDataFrame([(1, "10"), (2, "20")], "k int, v string")
    log = spark.createDataFrame(
        [(1, 4, "UpdateRows", 1, 2, "11"), (1, 4, "UpdateRows", 2, 1, "21"), (1, 9, "UpdateRows", 2, 7, "12")],
        "seq bigint, pos bigint, event_type string, was int, k int, v string")
    ops = [alter.ChangeColumn("k", "id", "bigint"), ModifyColumn("v", "int")]
    got = migrate_table(snap, ops, log, [KeySpec("pk", ("k",), True)], "mig_k", before_key="was")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 21), (7, 12)]


def test_migration_audits_the_log(spark):
    snap = spark.createDataFrame([(1, 10)], "k bigint, v bigint")
    log = spark.createDataFrame([(1, 4, "UpdateRows", 1, 2**40)], "seq bigint, pos bigint, event_type string, k bigint, v bigint")
    with pytest.raises(MigrationError, match="rejects"):
        migrate_table(snap, [ModifyColumn("v", "int", nullable=False)], log, [KeySpec("pk", ("k",), True)], "mig_x")
    nothing = spark.createDataFrame([(1, 4, "UpdateRows", 1, None)], log.schema)
    with pytest.raises(MigrationError, match="rejects"):
        migrate_table(snap, [ModifyColumn("v", "int", nullable=False)], nothing, [KeySpec("pk", ("k",), True)], "mig_x")
    assert not spark.catalog.tableExists("mig_x")


def test_migration_checks_added_keys_and_renames_the_key(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "a")], "k bigint, v string")
    log = spark.createDataFrame([(1, 4, "WriteRows", 3, "b")], LOG)
    with pytest.raises(MigrationError, match="does not hold"):
        migrate_table(snap, alter_specs(spark, "ALTER TABLE t ADD UNIQUE KEY u (v)"), log, [KeySpec("pk", ("k",), True)], "mig_y")
    got = migrate_table(snap, [alter.RenameColumn("k", "id")], log, [KeySpec("pk", ("k",), True)], "mig_y")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "b")] and got.columns == ["id", "v"]
