"""Times and durations as text and numbers; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted and written time formats.
ISO = "yyyy-MM-dd'T'HH:mm:ss"
MYSQL = "yyyy-MM-dd HH:mm:ss"
ISO_TEXT = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
MYSQL_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"


def _zoned(c: Column) -> Column:
    return c.cast("timestamp")


def to_unix_micros(c: Column) -> Column:
    return F.unix_micros(_zoned(c))


def to_unix_millis(c: Column) -> Column:
    return F.unix_millis(_zoned(c))


def to_unix(c: Column) -> Column:
    return F.unix_seconds(_zoned(c))


def from_unix_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def from_unix_millis(c: Column) -> Column:
    return F.timestamp_millis(c).cast("timestamp_ntz")


def from_unix(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def format_time(c: Column, pattern: str) -> Column:
    return F.date_format(_zoned(c), pattern)


def format_iso(c: Column) -> Column:
    return format_time(c, ISO + "xx")


def format_iso_utc(c: Column) -> Column:
    return format_time(c, ISO + "'Z'")


def format_iso_millis(c: Column) -> Column:
    return format_time(c, ISO + ".SSSxx")


def format_mysql(c: Column) -> Column:
    return format_time(c, MYSQL)


def format_mysql_micros(c: Column) -> Column:
    return format_time(c, MYSQL + ".SSSSSS")


def parse_time(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def parse_iso(c: Column) -> Column:
    """ISO 8601 with an offset, with Z, or without a zone; NULL if it is none."""
    return (
        F.when(c.rlike(rf"^{ISO_TEXT}[+-]\d{{4}}$"), parse_time(c, ISO + "xx"))
        .when(c.rlike(rf"^{ISO_TEXT}Z$"), parse_time(c, ISO + "'Z'"))
        .when(c.rlike(rf"^{ISO_TEXT}$"), parse_time(c, ISO))
    )


def parse_mysql(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with up to six decimals; NULL if it is none."""
    return F.when(c.rlike(MYSQL_TEXT), c.try_cast("timestamp_ntz"))


def part(c: Column, name: str) -> Column:
    """Year, month, day, hour, minute, second or millisecond."""
    if name == "millisecond":
        return (F.unix_millis(_zoned(c)) % 1000).cast("int")
    return F.date_part(F.lit(name), c).cast("int")


def add_seconds(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL '{n}' SECOND")


def add_minutes(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL '{n}' MINUTE")


def add_hours(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL '{n}' HOUR")


def add_days(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL '{n}' DAY")


def seconds_between(start: Column, end: Column) -> Column:
    return (to_unix_micros(end) - to_unix_micros(start)) / F.lit(1000000.0)


def _pieces(total: Column, days: bool) -> list[Column]:
    hours = F.floor(total / 3600)
    out = []
    if days:
        out.append((F.floor(total / 86400), "d "))
        hours = F.floor((total % 86400) / 3600)
    out += [(hours, "h "), (F.floor((total % 3600) / 60), "m ")]
    shown, columns = F.lit(False), []
    for value, unit in out:
        shown = shown | (value > 0)
        columns.append(F.when(shown, F.concat(value.cast("string"), F.lit(unit))).otherwise(F.lit("")))
    return [*columns, (total % 60).cast("string"), F.lit("s")]


def format_duration(seconds: Column) -> Column:
    """As ``1h 2m 5s``, leading zero parts left out; ``0s`` if negative."""
    total = F.floor(seconds).cast("bigint")
    return F.when(seconds < 0, F.lit("0s")).otherwise(F.concat(*_pieces(total, days=False)))


def format_duration_human(seconds: Column) -> Column:
    """As above with days; below one second in milliseconds."""
    total = F.floor(seconds).cast("bigint")
    millis = F.concat(F.floor(seconds * 1000).cast("string"), F.lit("ms"))
    return (
        F.when(seconds < 0, F.lit("0s")).when(seconds < 1, millis).otherwise(F.concat(*_pieces(total, days=True)))
    )


def format_duration_precise(seconds: Column) -> Column:
    """Seconds with three decimals, cut and not rounded; ``0s`` if negative."""
    millis = F.floor(seconds * 1000).cast("bigint")
    text = F.concat(
        F.floor(millis / 1000).cast("string"), F.lit("."), F.lpad((millis % 1000).cast("string"), 3, "0"), F.lit("s")
    )
    return F.when(seconds < 0, F.lit("0s")).otherwise(text)
