"""Hint tables, progress text and publishing."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import numbering, staging

#: Conditions under which a version's table, or its folder, is someone else's.
TAKEN = ("TABLE_OR_VIEW_ALREADY_EXISTS", "LOCATION_ALREADY_EXISTS")
HINT_SCHEMA = "id bigint, hint string, value string, ts timestamp_ntz"


def read_hints(spark: SparkSession, path: str, schema: str = HINT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_hints(hints: DataFrame, path: str, order: Sequence[str], exists: bool) -> None:
    """Append hint rows in the given order with ids above those in the table.

    Without a ``ts`` column the rows get the time of the append.
    """
    spark = hints.sparkSession
    start = 1
    if exists:
        start = (spark.read.parquet(path).agg(F.max("id")).first()[0] or 0) + 1
    rows = hints if "ts" in hints.columns else hints.withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
    numbered = numbering.with_row_number(rows, list(order), "id", start)
    keep = [c for c in rows.columns if c not in ("id", "hint", "value", "ts") and c not in order]
    numbered.select("id", *keep, "hint", "value", "ts").write.mode("append").parquet(path)


def progress_json(df: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Progress rows as JSON text; ``fields`` maps JSON names to columns."""
    body = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]))
    return df.select(*keys, body.alias("payload"))


def publish(
    df: DataFrame, name: str, version: int | None = None, path: str | None = None, drop_old: bool = False,
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Write a new version of a table, then switch the name to it.

    ``name`` is a view, so readers change over in one catalog step. A version is
    claimed by creating its empty table, which only one publisher can do; who
    comes second takes the next free number, or fails if it asked for that very
    one. If the write, the check or the switch fails, the version this call
    made, and no other, is dropped and the name still leads to the old one. With
    ``drop_old`` the version that the name led to is removed after the switch.
    ``path`` puts the data outside the warehouse, one folder for each version.
    """
    spark = df.sparkSession
    version = _claim(df, name, version, path)
    fresh = f"{name}_v{version}"
    try:
        df.select(*(F.col(f"`{c}`") for c in df.columns)).write.insertInto(fresh)
        if check is not None:
            check(spark.table(fresh))
        old = live_version(spark, name)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fresh}")
    except Exception:
        _drop(spark, fresh)
        raise
    if drop_old and old is not None and old != version:
        _drop(spark, f"{name}_v{old}")
    return spark.table(name)


def _claim(df: DataFrame, name: str, version: int | None, path: str | None) -> int:
    """Create the empty table of a version that nobody else has, and return its number."""
    spark = df.sparkSession
    number = version if version is not None else max(versions(spark, name), default=0) + 1
    while True:
        place = path and f"{path.rstrip('/')}/v{number}"
        try:
            if place and staging.exists(spark, place):
                raise ValueError(f"{place} exists")
            spark.catalog.createTable(f"{name}_v{number}", place, "parquet", df.schema)
            return number
        except (AnalysisException, ValueError) as taken:
            if isinstance(taken, AnalysisException) and taken.getCondition() not in TAKEN:
                raise
            if version is not None:
                raise ValueError(f"version {version} of {name} exists") from taken
            number += 1


def live_version(spark: SparkSession, name: str) -> int | None:
    """The version that a published name leads to, None if there is none."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'View Text'").collect()
    found = re.search(r"_v(\d+)$", rows[0]["data_type"].strip("` ")) if rows else None
    return int(found[1]) if found else None


def versions(spark: SparkSession, name: str) -> list[int]:
    """The version numbers of a published name that the catalog holds."""
    database, _, plain = name.rpartition(".")
    tables = spark.catalog.listTables(database or None, f"{plain}_v*")
    ends = [t.name[len(plain) + 2 :] for t in tables if t.name.lower().startswith(f"{plain.lower()}_v")]
    return [int(e) for e in ends if e.isascii() and e.isdigit()]


def _drop(spark: SparkSession, table: str) -> None:
    """Drop a table with its files, also where they are outside the warehouse."""
    if not spark.catalog.tableExists(table):
        return
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for row in rows:
        staging.drop_path(spark, row["data_type"])
