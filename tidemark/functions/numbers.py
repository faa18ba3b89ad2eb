"""Numbers and bytes out of text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# What counts as a whole and as a decimal number.
WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?((([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)|(?i:inf|infinity|nan))$"


def _whole(c: Column, type: str) -> Column:
    return F.when(trim(c).rlike(WHOLE), trim(c).try_cast(type))


def _unsigned(c: Column, top: int, type: str) -> Column:
    n = _whole(c, "decimal(38,0)")
    return F.when((n >= 0) & (n <= F.lit(str(top)).cast("decimal(38,0)")), n.cast(type))


def parse_int32(c: Column) -> Column:
    return _whole(c, "int")


def parse_int64(c: Column) -> Column:
    return _whole(c, "bigint")


def parse_uint16(c: Column) -> Column:
    return _unsigned(c, 2**16 - 1, "int")


def parse_uint32(c: Column) -> Column:
    return _unsigned(c, 2**32 - 1, "bigint")


def parse_uint64(c: Column) -> Column:
    return _unsigned(c, 2**64 - 1, "decimal(20,0)")


def parse_double(c: Column) -> Column:
    return F.when(trim(c).rlike(DECIMAL), trim(c).try_cast("double"))


def parse_float(c: Column) -> Column:
    return F.when(trim(c).rlike(DECIMAL), trim(c).try_cast("float"))


def to_text(c: Column, precision: int = 6) -> Column:
    """Decimal text with a fixed number of places, rounded from the exact value.

    From 2**53 on a double is a whole number; up to 2**84 its digits are put
    together from two exact parts.
    """
    x = c.cast("double")
    high = F.floor(F.abs(x) / 2.0**32)
    low = (F.abs(x) - high.cast("double") * 2.0**32).try_cast("bigint")
    whole = (high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + low).cast("decimal(38,0)").cast("string")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    large = F.concat(sign, whole, F.lit("." + "0" * precision if precision else ""))
    exact_whole = (F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**84)
    return F.when(exact_whole, large).otherwise(F.replace(F.format_number(x, precision), F.lit(","), F.lit("")))


def bool_text(c: Column) -> Column:
    return F.when(c, F.lit("true")).otherwise(F.lit("false"))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Text from hex digits, NULL if they are none."""
    return F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(c)).cast("string")
