"""Log positions ``file:offset`` and transaction ids ``domain:sequence``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_unsigned(text: Column) -> Column:
    """A non-negative whole number out of text, NULL for anything else."""
    n = F.trim(text).try_cast("bigint")
    return F.when(F.trim(text).rlike(r"^\+?[0-9]+$"), n)


def file_sequence(file: Column) -> Column:
    """Number after the last dot of a log file name, 0 if there is none."""
    return F.coalesce(as_unsigned(F.regexp_extract(file, r"\.([^.]*)$", 1)), F.lit(0).cast("bigint"))


def coordinate(file: Column, pos: Column) -> Column:
    """A position that compares by file number, then offset."""
    return F.struct(file_sequence(file).alias("seq"), pos.cast("bigint").alias("pos"))


def position_file(text: Column) -> Column:
    return F.when(position_offset(text).isNotNull(), F.split_part(text, F.lit(":"), F.lit(1)))


def position_offset(text: Column) -> Column:
    """Offset of ``file:offset`` text with exactly two parts, else NULL."""
    two = F.size(F.split(text, ":")) == 2
    return F.when(two, as_unsigned(F.split_part(text, F.lit(":"), F.lit(2))))


def txn_domain(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def txn_sequence(text: Column) -> Column:
    """Sequence of ``domain:sequence``; NULL if there is no colon or no number."""
    return as_unsigned(
        F.when(F.contains(text, F.lit(":")), F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    )


def valid_txn(text: Column) -> Column:
    return (txn_domain(text) != "") & (F.coalesce(txn_sequence(text), F.lit(0)) > 0)


def at_or_after(seq: Column, pos: Column, from_seq: int, from_pos: int) -> Column:
    """Position >= start; the first conjunct alone can prune files."""
    return (seq >= from_seq) & ((seq > from_seq) | (pos >= from_pos))


def after(seq: Column, pos: Column, from_seq: int, from_pos: int) -> Column:
    return (seq >= from_seq) & ((seq > from_seq) | (pos > from_pos))


def up_to(seq: Column, pos: Column, to_seq: int, to_pos: int) -> Column:
    return (seq <= to_seq) & ((seq < to_seq) | (pos <= to_pos))
