"""Schema changes as one projection.

All operations of an ALTER are folded into one ordered list of output
columns, so a table is rewritten by a single ``select``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import numbering
from .inspect import KeySpec, duplicate_key_rows, find_column, key_check


class AlterError(ValueError):
    """An ALTER that cannot be carried out."""


@dataclass(frozen=True)
class AddColumn:
    name: str
    type: str
    default: Any = None
    nullable: bool = True
    first: bool = False
    after: str | None = None


@dataclass(frozen=True)
class DropColumn:
    name: str


@dataclass(frozen=True)
class ModifyColumn:
    """Retype in place. ``expression`` overrides the plain cast."""

    name: str
    type: str
    nullable: bool = True
    first: bool = False
    after: str | None = None
    values: tuple[str, ...] = ()
    expression: Column | None = None


@dataclass(frozen=True)
class ChangeColumn:
    """Rename and retype; the values follow."""

    old: str
    name: str
    type: str
    nullable: bool = True
    first: bool = False
    after: str | None = None
    values: tuple[str, ...] = ()
    expression: Column | None = None


@dataclass(frozen=True)
class RenameColumn:
    old: str
    name: str


@dataclass(frozen=True)
class RenameTable:
    name: str


@dataclass(frozen=True)
class TableOption:
    """An operation without effect on rows: index, engine, charset, comment."""

    kind: str
    name: str = ""
    columns: tuple[str, ...] = ()


@dataclass
class ColumnPairs:
    """Which columns survive, vanish, appear and change."""

    shared: list[tuple[str, str]] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)


# Column type names and the Spark types that hold them.
TYPE_NAMES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int",
    "integer": "int", "bigint": "bigint", "float": "float", "double": "double",
    "real": "double", "double precision": "double", "bit": "bigint",
    "decimal": "decimal(10,0)", "numeric": "decimal(10,0)", "dec": "decimal(10,0)", "fixed": "decimal(10,0)",
    "tinytext": "string", "mediumtext": "string", "longtext": "string", "nchar": "string", "nvarchar": "string",
    "tinyblob": "binary", "mediumblob": "binary", "longblob": "binary", "varbinary": "binary",
    "char": "string", "varchar": "string", "text": "string",
    "enum": "string", "set": "string", "json": "string", "time": "string",
    "geometry": "string", "point": "string", "linestring": "string", "polygon": "string",
    "blob": "binary", "datetime": "timestamp_ntz", "timestamp": "timestamp",
    "date": "date", "year": "smallint", "bool": "boolean", "boolean": "boolean",
    "string": "string", "binary": "binary", "timestamp_ntz": "timestamp_ntz",
}
# The next wider type an unsigned integer needs.
UNSIGNED = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}


def spark_type(text: str) -> str:
    """Spark type for a column type such as ``VARCHAR(20)`` or ``INT UNSIGNED``."""
    match = re.match(r"\s*([A-Za-z_]+)\s*(\([^)]*\))?(.*)$", text, re.S)
    if not match or match[1].lower() not in TYPE_NAMES:
        raise AlterError(f"unknown column type {text!r}")
    name = match[1].lower()
    if TYPE_NAMES[name].startswith("decimal") and match[2]:
        return "decimal" + match[2].replace(" ", "")
    base = TYPE_NAMES[name]
    return UNSIGNED.get(base, base) if "unsigned" in match[3].lower() else base


# Bytes of the whole-number types.
INTEGER_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def safe_cast(value: Column, source: str | None, target: str) -> Column:
    """Cast that gives NULL for values the target cannot hold.

    Between whole-number types the range is compared, as a failing
    ``try_cast`` costs an exception per row.
    """
    if source in INTEGER_BYTES and target in INTEGER_BYTES:
        if INTEGER_BYTES[source] <= INTEGER_BYTES[target]:
            return value.cast(target)
        top = 2 ** (8 * INTEGER_BYTES[target] - 1)
        return F.when(value.between(-top, top - 1), value.cast(target))
    return value.try_cast(target)


def max_length(text: str) -> int | None:
    """Length limit of ``CHAR(n)`` and ``VARCHAR(n)``."""
    match = re.match(r"\s*(?:var)?char\s*\(\s*(\d+)\s*\)", text, re.I)
    return int(match[1]) if match else None


def _need(df: DataFrame, name: str) -> str:
    found = find_column(df, name)
    if found is None:
        raise AlterError(f"no column {name}")
    return found


def _place(order: list[str], name: str, first: bool, after: str | None) -> None:
    """Put ``name`` first, after a column, or leave it where it is (else last)."""
    if first or after:
        if name in order:
            order.remove(name)
        at = 0
        if after:
            spot = next((i for i, c in enumerate(order) if c.lower() == after.lower()), None)
            if spot is None:
                raise AlterError(f"no column {after}")
            at = spot + 1
        order.insert(at, name)
    elif name not in order:
        order.append(name)


def _fold(df: DataFrame, ops: Sequence[Any]) -> tuple[list[str], dict[str, Column], ColumnPairs]:
    if not ops:
        raise AlterError("no operations")
    if any(isinstance(op, RenameTable) for op in ops):
        raise AlterError("renaming the table is not supported here")
    order = list(df.columns)
    source = {c: c for c in df.columns}
    value: dict[str, Column] = {c: F.col(c) for c in df.columns}
    held: dict[str, str | None] = {c: t for c, t in df.dtypes}
    pairs = ColumnPairs()

    def rename(old: str, new: str) -> None:
        if new.lower() != old.lower() and any(c.lower() == new.lower() for c in order):
            raise AlterError(f"column {new} exists")
        order[order.index(old)] = new
        value[new] = value.pop(old)
        held[new] = held.pop(old)
        if old in source:
            source[new] = source.pop(old)

    def current(name: str) -> str:
        found = next((c for c in order if c.lower() == name.lower()), None)
        if found is None:
            raise AlterError(f"no column {name}")
        return found

    for op in ops:
        if isinstance(op, AddColumn):
            if any(c.lower() == op.name.lower() for c in order):
                raise AlterError(f"column {op.name} exists")
            if not op.nullable and op.default is None:
                raise AlterError(f"NOT NULL column {op.name} needs a default")
            value[op.name] = F.lit(op.default).cast(spark_type(op.type))
            held[op.name] = spark_type(op.type)
            _place(order, op.name, op.first, op.after)
            pairs.added.append(op.name)
        elif isinstance(op, DropColumn):
            name = current(op.name)
            order.remove(name)
            value.pop(name)
            source.pop(name, None)
            pairs.dropped.append(name)
        elif isinstance(op, (ModifyColumn, ChangeColumn)):
            name = current(op.old if isinstance(op, ChangeColumn) else op.name)
            target = op.name if isinstance(op, ChangeColumn) else name
            plain = op.expression is None
            base, source_type = (value[name], held[name]) if plain else (op.expression, None)
            held[name] = spark_type(op.type)
            value[name] = safe_cast(base, source_type, held[name])
            if target != name:
                rename(name, target)
            _place(order, target, op.first, op.after)
            pairs.modified.append(target)
        elif isinstance(op, RenameColumn):
            rename(current(op.old), op.name)
    pairs.shared = [(source[c], c) for c in order if c in source]
    return order, value, pairs


def column_pairs(df: DataFrame, ops: Sequence[Any]) -> ColumnPairs:
    return _fold(df, ops)[2]


def alter_table(df: DataFrame, ops: Sequence[Any]) -> DataFrame:
    """Apply all operations in one projection."""
    order, value, _ = _fold(df, ops)
    return df.select(*[value[c].alias(c) for c in order])


def add_column(df: DataFrame, name: str, type: str, default: Any = None, nullable: bool = True,
               first: bool = False, after: str | None = None) -> DataFrame:
    return alter_table(df, [AddColumn(name, type, default, nullable, first, after)])


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return alter_table(df, [DropColumn(name)])


def modify_column(df: DataFrame, name: str, type: str, first: bool = False,
                  after: str | None = None) -> DataFrame:
    return alter_table(df, [ModifyColumn(name, type, first=first, after=after)])


def change_column(df: DataFrame, old: str, new: str, type: str) -> DataFrame:
    return alter_table(df, [ChangeColumn(old, new, type)])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return alter_table(df, [RenameColumn(old, new)])


def add_unique_key(df: DataFrame, columns: Sequence[str], primary: bool = False) -> DataFrame:
    """Rows that stop the key from being added; empty if it can be.

    A primary key also rejects NULLs.
    """
    names = [_need(df, c) for c in columns]
    bad = duplicate_key_rows(df, names).withColumn("reason", F.lit("duplicate"))
    if primary:
        missing = F.lit(False)
        for c in names:
            missing = missing | F.col(c).isNull()
        bad = bad.unionByName(df.where(missing).withColumn("reason", F.lit("null")))
    return bad


def require_unique(df: DataFrame, columns: Sequence[str], primary: bool = False) -> None:
    """Raise if the key does not hold; reads two counts."""
    row = key_check(df, [KeySpec("key", tuple(columns), primary)]).first()
    if row["duplicates"] or (primary and row["null_rows"]):
        raise AlterError(f"key {tuple(columns)} does not hold: {row.asDict()}")


def write_indexed(df: DataFrame, columns: Sequence[str], name: str, buckets: int) -> None:
    """Save as a table bucketed and sorted by the key, so later joins on it
    need no shuffle of this side."""
    df.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(name)


def _kind_of(kind: str) -> str:
    """number, time or other."""
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")):
        return "number"
    return "time" if kind.startswith(("date", "timestamp")) else "other"


def _may_cut(old: str, new: str) -> bool:
    """Whether a cast between these types may keep a changed value."""
    return old != new and _kind_of(old) == _kind_of(new) != "other"


def cast_audit(df: DataFrame, ops: Sequence[Any]) -> DataFrame:
    """Rows each change would reject or cut, per column and reason.

    Reasons: ``cast`` (no value in the new type, or a number or time that
    loses digits), ``length``, ``null`` and ``value`` (not in the value list). A
    column renamed before by the same list is named as it is in ``df``; columns
    that the list adds are not audited. One aggregate over the table.
    """
    tests: list[tuple[str, str, Column]] = []
    source = {c.lower(): c for c in df.columns}  # by the name at this point of the list
    for op in ops:
        if isinstance(op, RenameColumn):
            source[op.name.lower()] = source.pop(op.old.lower(), None)
        if isinstance(op, DropColumn):
            source.pop(op.name.lower(), None)
        if isinstance(op, AddColumn):
            source[op.name.lower()] = None
        if not isinstance(op, (ModifyColumn, ChangeColumn)):
            continue
        at = (op.old if isinstance(op, ChangeColumn) else op.name).lower()
        if at not in source:
            raise AlterError(f"no column {at}")
        name = source.pop(at)
        source[op.name.lower()] = name
        if name is None:
            continue
        c = F.col(name)
        plain = op.expression is None
        base = c if plain else op.expression
        cast = safe_cast(base, dict(df.dtypes)[name] if plain else None, spark_type(op.type))
        lost = base.isNotNull() & cast.isNull()
        held = dict(df.dtypes)[name]
        if plain and _may_cut(held, spark_type(op.type)):
            # cast back, a value that was cut is another one
            lost = F.coalesce(lost | ~cast.try_cast(held).eqNullSafe(base), F.lit(False))
        tests.append((name, "cast", lost))
        if (limit := max_length(op.type)) is not None:
            tests.append((name, "length", F.length(c.cast("string")) > limit))
        if not op.nullable:
            tests.append((name, "null", c.isNull()))
        if op.values:
            tests.append((name, "value", c.isNotNull() & ~c.cast("string").isin(*op.values)))
    if not tests:
        return df.sparkSession.createDataFrame([], "column_name string, reason string, bad_rows bigint")
    counted = df.agg(*[F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])
    entries = [
        F.struct(
            F.lit(n).alias("column_name"), F.lit(r).alias("reason"), F.col(f"t{i}").alias("bad_rows")
        )
        for i, (n, r, _) in enumerate(tests)
    ]
    return counted.select(F.inline(F.array(*entries)))


def add_auto_increment(
    df: DataFrame, order: Sequence[str], name: str = "id", one_task: bool | None = None
) -> DataFrame:
    """Dense ids 1..N in key order."""
    numbered = numbering.with_row_number(df, list(order), name, one_task=one_task)
    return numbered.select(name, *df.columns)


def schema_diff(original: DataFrame, shadow: DataFrame) -> DataFrame:
    """Columns on either side, matched ignoring case, with types and NULLs."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return column_profile_nulls(df).select(
            F.lower("column_name").alias("column_name"),
            F.col("data_type").alias(f"{tag}_type"),
            F.col("nulls").alias(f"{tag}_nulls"),
        )

    joined = side(original, "original").join(side(shadow, "shadow"), "column_name", "full")
    return joined.select(
        "column_name",
        "original_type",
        "shadow_type",
        "original_nulls",
        "shadow_nulls",
        F.when(F.col("shadow_type").isNull(), "only_original")
        .when(F.col("original_type").isNull(), "only_shadow")
        .otherwise("both")
        .alias("presence"),
        F.coalesce(F.col("original_type") == F.col("shadow_type"), F.lit(False)).alias("same_type"),
    )


def column_profile_nulls(df: DataFrame) -> DataFrame:
    """Name, type and NULL count per column in one pass, without distincts."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"n{i}").alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries)))
