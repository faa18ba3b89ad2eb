"""Text expressions: trimming, escaping, quoting, splitting, matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six blanks and the ASCII letters.
BLANKS = " \t\n\r\f\v"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Characters escaped inside a quoted SQL value, backslash first.
SQL_ESCAPES = [
    ("\\", "\\\\"), ("'", "''"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0"),
]
# Characters with a short escape in JSON, backslash first.
JSON_ESCAPES = [
    ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"),
]
# The other control characters, written as four hex digits.
JSON_CONTROLS = [c for c in range(32) if chr(c) not in "\n\r\t\b\f"]


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def trim(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def trim_left(c: Column, chars: str = BLANKS) -> Column:
    return F.ltrim(c, F.lit(chars))


def trim_right(c: Column, chars: str = BLANKS) -> Column:
    return F.rtrim(c, F.lit(chars))


def _ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def upper_ascii(c: Column) -> Column:
    """Upper case for ASCII letters only; other letters stay as they are."""
    return F.when(_ascii_only(c), F.upper(c)).otherwise(F.translate(c, LOWER, UPPER))


def lower_ascii(c: Column) -> Column:
    return F.when(_ascii_only(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def capitalize(c: Column) -> Column:
    return F.concat(upper_ascii(F.left(c, F.lit(1))), lower_ascii(F.substr(c, F.lit(2))))


def find(c: Column, part: str) -> Column:
    """Position from 0, -1 if absent."""
    return F.instr(c, part) - 1


def replace_first(c: Column, old: str, new: str) -> Column:
    if not old:
        return c
    at = F.instr(c, old)
    cut = F.concat(
        F.left(c, at - 1), F.lit(new), F.substr(c, at + len(old))
    )
    return F.when(at == 0, c).otherwise(cut)


def replace_last(c: Column, old: str, new: str) -> Column:
    if not old:
        return c
    before = F.substring_index(c, old, -1)
    head = F.left(c, F.char_length(c) - F.char_length(before) - len(old))
    return F.when(F.contains(c, F.lit(old)), F.concat(head, F.lit(new), before)).otherwise(c)


def pad_left(c: Column, length: int, pad: str = " ") -> Column:
    """Fill up to ``length``; longer text is kept whole."""
    return F.when(F.char_length(c) >= length, c).otherwise(F.lpad(c, length, pad))


def pad_right(c: Column, length: int, pad: str = " ") -> Column:
    return F.when(F.char_length(c) >= length, c).otherwise(F.rpad(c, length, pad))


def take(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def drop(c: Column, n: int) -> Column:
    return F.substr(c, F.lit(n + 1))


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """``length`` characters from a start counted from 0."""
    return F.substr(c, F.lit(start + 1)) if length is None else F.substr(c, F.lit(start + 1), F.lit(length))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def fill(template: str, *values: Column) -> Column:
    """Put values into the places ``{0}``, ``{1}``, ... of a template."""
    out = F.lit(template)
    for i, v in enumerate(values):
        out = F.replace(out, F.lit("{%d}" % i), v.cast("string"))
    return out


def escape_sql(c: Column) -> Column:
    return replace_all(c, SQL_ESCAPES)


def quote_sql(c: Column, quote: str = "'") -> Column:
    return F.concat(F.lit(quote), escape_sql(c), F.lit(quote))


def sql_value(c: Column) -> Column:
    """A quoted value, or the word NULL without quotes."""
    return F.coalesce(quote_sql(c.cast("string")), F.lit("NULL"))


def quote_identifier(c: Column, quote: str = "`") -> Column:
    return F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def combine_database_table(db: Column, table: Column) -> Column:
    return F.concat(quote_identifier(db), F.lit("."), quote_identifier(table))


def normalize_name(c: Column) -> Column:
    """Trim, then take off one pair of equal quotes around the name."""
    name = trim(c)
    first = F.left(name, F.lit(1))
    quoted = (
        (F.char_length(name) >= 2)
        & first.isin("'", '"', "`")
        & (first == F.right(name, F.lit(1)))
    )
    return F.when(quoted, F.substr(name, F.lit(2), F.char_length(name) - 2)).otherwise(name)


def escape_json(c: Column) -> Column:
    common = replace_all(c, JSON_ESCAPES)
    rare = replace_all(common, [(chr(n), "\\u%04x" % n) for n in JSON_CONTROLS])
    return F.when(common.rlike(r"[\x00-\x1f]"), rare).otherwise(common)


def unescape_json(c: Column) -> Column:
    """Undo ``escape_json``; a backslash that starts no escape is kept.

    The text is cut at escaped backslashes, so in each part a backslash can
    start at most one escape and the escapes can be replaced one by one.
    """
    pair, slash = "\\\\", "\\"

    def coded(part: Column) -> Column:
        # four-digit codes: read the part as a JSON string
        lone = F.regexp_replace(part, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
        plain = replace_all(lone, [p for p in JSON_ESCAPES if p[0] != slash])
        return F.get_json_object(F.concat(F.lit('{"v":"'), plain, F.lit('"}')), "$.v")

    def read(part: Column) -> Column:
        known = part
        for char, escape in JSON_ESCAPES:
            if char != slash:
                known = F.replace(known, F.lit(escape), F.lit(char))
        return F.when(F.contains(part, F.lit("\\u")), F.coalesce(coded(known), known)).otherwise(known)

    parts = F.transform(F.split(c, r"\\\\"), read)
    return F.when(F.contains(c, F.lit(pair)), F.array_join(parts, slash)).otherwise(read(c))


def split_char(c: Column, delimiter: str) -> Column:
    """Split by one character; a trailing empty part is dropped, an empty text has no part."""
    parts = F.split(c, "\\Q" + delimiter + "\\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_text(c: Column, delimiter: str) -> Column:
    """Split by a text, all parts kept; an empty delimiter gives the characters."""
    if delimiter:
        return F.split(c, "\\Q" + delimiter + "\\E")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def split_lines(c: Column) -> Column:
    """Lines without their line ends."""
    return F.transform(split_char(c, "\n"), lambda x: F.rtrim(x, F.lit("\r\n")))


def like_pattern(pattern: str) -> str:
    """LIKE pattern for a wildcard pattern of ``*`` and ``?``."""
    out = pattern
    for ch in ("\\", "%", "_"):
        out = out.replace(ch, "\\" + ch)
    return out.replace("*", "%").replace("?", "_")


def like_patterns(c: Column) -> Column:
    """LIKE patterns for a column of wildcard patterns."""
    for ch in ("\\", "%", "_"):
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return F.translate(c, "*?", "%_")
