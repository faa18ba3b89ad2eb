"""The whole change of one table, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alter, changelog, inspect, verify
from ..operators.inspect import KeySpec
from ..sources import sinks
from . import staging


class MigrationError(RuntimeError):
    """A check failed; the published table is unchanged."""


#: Rows that differ named in an error.
SHOWN = 5


def migrate_table(
    snapshot: DataFrame,
    ops: Sequence[Any],
    log: DataFrame,
    keys: Sequence[KeySpec],
    name: str,
    version: int | None = None,
    path: str | None = None,
    before_key: str | None = None,
) -> DataFrame:
    """Alter, catch up with the log, verify and publish a table.

    ``log`` holds the row events of the table since the snapshot. Returns the
    published table. Raises before publishing if no key holds, if the snapshot
    or what the log leads to has values that the new schema would reject or
    cut, if an added unique or primary key does not hold, or if the written
    rows differ from those that come of altering the snapshot and the log
    apart. The old version stays published then. ``before_key`` names the log's
    column with the old value of a key of one column, if updates may change it.
    """
    altered = alter.alter_table(snapshot, ops)
    new_name = dict(alter.column_pairs(snapshot, ops).shared)
    # the key is checked under its old name, so it may be renamed
    kept = altered.select(*[F.col(new).alias(old) for old, new in new_name.items()])
    picked = inspect.shared_key(snapshot, kept, keys).first()
    if picked is None:
        raise MigrationError("no usable key in both tables")
    key = picked["key_columns"].split(",")
    new_key = [new_name[c] for c in key]

    if before_key is not None and len(key) > 1:
        raise MigrationError(f"the old values of {', '.join(key)} are not one column")

    # written once: the audit and the new version both read it
    spark = snapshot.sparkSession
    place = staging.new_path(spark, "caught-up")
    caught_up = staging.stage_at(changelog.apply_changes(snapshot, log, key, before_key=before_key), place)
    for audited in (snapshot, caught_up):
        rejected = alter.cast_audit(audited, ops).where("bad_rows > 0").collect()
        if rejected:
            raise MigrationError(f"rows the new schema rejects: {rejected}")
    again = changelog.apply_changes(altered, alter.alter_table(log, ops), new_key, before_key=before_key)
    pairs = [(c, c) for c in altered.columns if c not in new_key]

    def check(written: DataFrame) -> None:
        differing = verify.compare_tables(again, written, new_key, pairs).limit(SHOWN).collect()
        if differing:
            raise MigrationError(f"verification failed, among others: {differing}")
        for op in ops:
            if isinstance(op, alter.TableOption) and op.kind in ("AddUniqueKey", "AddPrimaryKey"):
                try:
                    alter.require_unique(written, op.columns, op.kind == "AddPrimaryKey")
                except alter.AlterError as failed:
                    raise MigrationError(str(failed)) from failed

    try:
        return sinks.publish(alter.alter_table(caught_up, ops), name, version, path, check=check)
    finally:
        staging.drop_path(spark, place)
