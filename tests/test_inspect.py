"""Profiles, estimates and audits on hand-made tables."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import alter, columns, inspect
from tidemark.operators.alter import ModifyColumn


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_of_many_columns_copies_no_rows(spark):
    kinds = ["string", "double", "bigint", "timestamp_ntz", "boolean"]
    df = spark.range(200).select(*(
        (F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % (i + 1))).cast("string" if i % 5 == 3 else kinds[i % 5]).alias(f"c.{i}")
        for i in range(50)))
    got = inspect.column_profile(df)
    assert "Expand" not in plan_of(got) and "Window" not in plan_of(got)
    rows = {r.column_name: r for r in got.collect()}
    for i, c in enumerate(df.columns):
        want = df.agg(F.count("*").alias("n"), F.count(f"`{c}`").alias("given"), F.count_distinct(f"`{c}`").alias("d"), F.min(f"`{c}`").cast("string").alias("lo")).first()
        r = rows[c]
        assert (r["rows"], r.nulls, r.distinct_values, r.min_value) == (want.n, want.n - want.given, want.d, want.lo)
    assert [r.distinct_values for r in inspect.column_profile(df, approximate=True).where("column_name = 'c.1'").collect()] == [2]


def test_profile_of_zeros_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), None), (float("nan"), None)], "a double, b string")
    got = {r.column_name: (r["rows"], r.nulls, r.distinct_values) for r in inspect.column_profile(df).collect()}
    assert got == {"a": (4, 0, 2), "b": (4, 4, 0)}
    empty = {r.column_name: (r["rows"], r.distinct_values, r.min_value) for r in inspect.column_profile(df.limit(0)).collect()}
    assert empty == {"a": (0, 0, None), "b": (0, 0, None)}


def test_estimate_reads_some_footers_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).repartition(40).write.parquet(path)
    exact = inspect.row_count_estimate(spark, path).first()
    assert (exact.estimated_rows, exact.standard_error) == (5000, 0.0)
    some = inspect.row_count_estimate(spark, path, most_files=5).first()
    assert abs(some.estimated_rows - 5000) < 500 and some.standard_error >= 0
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert inspect.row_count_estimate(spark, str(tmp_path / "none")).first().estimated_rows == 0


def test_values_that_a_cast_would_cut(spark):
    rows = [(datetime(2024, 1, 1, 5), 0.1, 2**53 + 1, 7), (datetime(2024, 1, 1), 0.5, 2**53, 300), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, d double, n bigint, s int")
    for column, kind, bad in (("t", "date", 1), ("d", "float", 1), ("n", "double", 1), ("s", "tinyint", 1), ("s", "bigint", 0), ("d", "decimal(5,1)", 0), ("t", "varchar(30)", 0)):
        got = alter.cast_audit(df, [ModifyColumn(column, kind)]).where("reason = 'cast'").first()
        assert (column, kind, got.bad_rows) == (column, kind, bad)


def test_quotes_of_every_kind_hold_operations_together(spark):
    statements = [
        '''ALTER TABLE t ADD a INT COMMENT "x,y", DROP b''', r'''ALTER TABLE t ADD c VARCHAR(9) DEFAULT 'it\'s, ok', DROP COLUMN b''',
        '''ALTER TABLE t ADD d VARCHAR(9) DEFAULT 'it''s, (ok', DROP b''', '''ALTER TABLE t ADD e INT COMMENT "it's, \\"so\\",", DROP b''',
        '''ALTER TABLE t DROP `b`, ADD f INT COMMENT 'unclosed''',
    ]
    df = spark.createDataFrame(list(enumerate(statements)), "i int, s string")
    got = {}
    for r in columns.ddl_operations(df, "s", ["i"]).orderBy("i", "op_no").collect():
        got.setdefault(r.i, []).append((r.kind, r.name, r.definition))
    drop = ("DropColumn", "b", None)
    assert got == {
        0: [("AddColumn", "a", 'INT COMMENT "x,y"'), drop], 1: [("AddColumn", "c", r"VARCHAR(9) DEFAULT 'it\'s, ok'"), drop],
        2: [("AddColumn", "d", "VARCHAR(9) DEFAULT 'it''s, (ok'"), drop], 3: [("AddColumn", "e", '''INT COMMENT "it's, \\"so\\","'''), drop],
        4: [drop, ("AddColumn", "f", "INT COMMENT 'unclosed")],
    }
