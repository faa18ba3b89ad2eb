"""Text, number, time and statement columns as jobs over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import coords, numbers, text, times
from ..plans import sizes, skew, staging


def text_columns(df: DataFrame, column: str, keep: Sequence[str], needle: str, label: Column) -> DataFrame:
    """Every text helper applied to one column."""
    c = F.col(column)
    low, needle_low = text.lower_ascii(c), needle.lower()
    return sizes.spread(df, list(keep)).select(
        *keep,
        text.trim(c).alias("trimmed"),
        text.trim_left(c).alias("trimmed_left"),
        text.trim_right(c).alias("trimmed_right"),
        text.trim(c, ".E").alias("trimmed_chars"),
        text.upper_ascii(c).alias("upper"),
        low.alias("lower"),
        text.capitalize(c).alias("capitalized"),
        F.contains(c, F.lit(needle)).alias("has"),
        F.contains(low, F.lit(needle_low)).alias("has_any_case"),
        F.startswith(c, F.lit(needle)).alias("starts"),
        F.startswith(low, F.lit(needle_low)).alias("starts_any_case"),
        F.endswith(c, F.lit(needle)).alias("ends"),
        F.endswith(low, F.lit(needle_low)).alias("ends_any_case"),
        text.find(c, needle).alias("found_at"),
        text.find(low, needle_low).alias("found_any_case"),
        text.replace_first(c, needle, "<1>").alias("replaced_first"),
        F.replace(c, F.lit(needle), F.lit("<*>")).alias("replaced_all"),
        text.replace_last(c, needle, "<n>").alias("replaced_last"),
        text.pad_left(c, 300, ".").alias("padded_left"),
        text.pad_right(c, 300, ".").alias("padded_right"),
        F.repeat(text.take(c, 5), F.lit(3)).alias("repeated"),
        text.substring(c, 5, 20).alias("middle"),
        text.take(c, 10).alias("taken"),
        text.drop(c, 10).alias("dropped"),
        (c == "").alias("empty"),
        text.is_blank(c).alias("blank"),
        label.alias("label"),
    )


def split_join_rows(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per line, with its parts counted and joined again."""
    lines = sizes.spread(df, list(keep)).select(*keep, F.posexplode(text.split_lines(F.col(column))).alias("line_no", "line"))
    line = F.col("line")
    words = text.split_char(line, " ")
    return lines.select(
        "*",
        F.size(words).alias("words"),
        F.size(text.split_text(line, ". ")).alias("sentences"),
        F.size(text.split_text(line, "")).alias("characters"),
        F.array_join(words, "|").alias("joined"),
    )


def parse_numbers(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Text read as each number type, NULL where it is none."""
    c = F.col(column)
    return df.select(
        *keep,
        numbers.parse_int32(c).alias("int32"),
        numbers.parse_int64(c).alias("int64"),
        numbers.parse_uint16(c).alias("uint16"),
        numbers.parse_uint32(c).alias("uint32"),
        numbers.parse_uint64(c).cast("string").alias("uint64"),
        numbers.parse_double(c).alias("double_value"),
        numbers.parse_float(c).alias("float_value"),
        numbers.to_text(numbers.parse_double(c), 2).alias("two_places"),
        numbers.bool_text(numbers.parse_double(c).isNotNull()).alias("is_number"),
        numbers.to_hex(c).alias("hex_text"),
        numbers.from_hex(numbers.to_hex(c)).alias("unhexed"),
    )


def escape_columns(df: DataFrame, column: str, keep: Sequence[str], name: Column) -> DataFrame:
    c = F.col(column)
    return sizes.spread(df, list(keep)).select(
        *keep,
        text.escape_sql(c).alias("sql_escaped"),
        text.quote_sql(c).alias("sql_quoted"),
        text.quote_identifier(name).alias("identifier"),
        text.escape_json(c).alias("json_escaped"),
        text.unescape_json(text.escape_json(c)).alias("json_round_trip"),
        text.normalize_name(F.concat(F.lit(" "), text.quote_identifier(name), F.lit("\n"))).alias("plain_name"),
        text.combine_database_table(F.lit("shop"), name).alias("full_name"),
    )


def wildcard_match(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """One row per row and pattern that matches (``*`` any run, ``?`` one character).

    The patterns are part of the expression, so rows are not joined to them.
    """
    hits = [F.when(F.col(column).like(text.like_pattern(p)), F.lit(p)) for p in patterns]
    return df.select("*", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))


#: Length of the literal stretches that index a table of patterns.
GRAM = 3
#: Patterns that a task may hold.
MOST_BROADCAST_PATTERNS = 500_000


def _grams(c: Column, n: int) -> Column:
    """All stretches of ``n`` characters, each once."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.concat(F.lit("g"), F.substring(c, i, F.lit(n)))))
    return F.when(F.length(c) >= n, found).otherwise(F.array().cast("array<string>"))


def _placed(c: Column, n: int, side: str) -> Column:
    """All stretches of ``n`` characters with their distance from the front (``^``) or back (``$``)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    at = (lambda i: i) if side == "^" else (lambda i: F.length(c) - i)
    found = F.transform(starts, lambda i: F.concat(F.lit(side + str(n) + ":"), at(i).cast("string"), F.lit(":"), F.substring(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, found).otherwise(F.array().cast("array<string>"))


def wildcard_join(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """As ``wildcard_match``, with a table of patterns of any length.

    A pattern is indexed by one key that all its matches hold, the one that the
    fewest rows hold: a stretch of up to GRAM characters of its longest literal,
    such a stretch at its place in the literal before the first ``*`` or behind
    the last one, or, without ``*``, its length. Rows meet the patterns whose key
    they hold in an equality join, and are then tested, first by the literals at
    both ends. Patterns without a wildcard are looked up whole; what has no
    literal at all (``*``, ``?*``) meets all rows, as nearly all match. Repeated
    patterns count once; NULL matches nothing.
    """
    literals = F.transform(F.split("pattern", "[*?]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("text")))
    given = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    given = given.withColumn("_literal", F.array_max(literals))
    given = given.select(
        "pattern", F.col("_literal.n").alias("n"), F.col("_literal.text").alias("literal"),
        F.regexp_extract("pattern", "^[^*?]*", 0).alias("head"), F.regexp_extract("pattern", "[^*?]*$", 0).alias("tail"),
        F.contains("pattern", F.lit("*")).alias("open"))
    none = F.array().cast("array<string>")
    by_end = [
        F.when((F.length(end) >= n) if n == GRAM else (F.length(end) == n), _placed(F.col(end), n, side)).otherwise(none)
        for end, side in (("head", "^"), ("tail", "$")) for n in range(1, GRAM + 1)]
    inner = (
        F.when(F.col("n") >= GRAM, _grams(F.col("literal"), GRAM))
        .when(F.col("n") > 0, F.array(F.concat(F.lit("g"), "literal"))).otherwise(none)
    )
    length = F.when(~F.col("open"), F.array(F.concat(F.lit("#"), F.length("pattern").cast("string")))).otherwise(none)
    all_keys = F.concat(inner, *by_end, length)
    keys = (
        F.when(~F.col("pattern").rlike("[*?]"), F.array(F.concat(F.lit("="), "pattern")))
        .when(F.size(all_keys) > 0, all_keys).otherwise(F.array(F.lit("")))
    )
    indexed = staging.stage(given.select("pattern", "n", "head", "tail", F.explode(keys).alias("key")), "patterns")
    first = F.left("key", F.lit(1))
    kind = (
        F.when(first == "g", F.concat(first, F.least("n", F.lit(GRAM)).cast("string")))
        .when(first.isin("^", "$"), F.left("key", F.lit(2))).otherwise(first))
    kinds = {r[0] for r in indexed.select(kind).distinct().collect()}  # a dozen at most
    value = F.col(column)
    held = [F.array(F.concat(F.lit("="), value))] if "=" in kinds else []
    held += [_grams(value, n) for n in range(1, GRAM + 1) if f"g{n}" in kinds]
    held += [_placed(value, n, side) for side in "^$" for n in range(1, GRAM + 1) if f"{side}{n}" in kinds]
    held += [F.array(F.concat(F.lit("#"), F.length(value).cast("string")))] if "#" in kinds else []
    held += [F.array(F.lit(""))] if "" in kinds else []
    if not held:
        return df.select("*", F.lit(None).cast("string").alias("pattern")).limit(0)
    dealt = sizes.spread(df, [column])
    keyed = lambda *cols: dealt.where(value.isNotNull()).select(*cols, F.explode(F.concat(*held)).alias("key"))
    wanted = indexed.select("key").distinct()
    often = keyed().join(wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    rarest = indexed.join(often, "key", "left").groupBy("pattern", "head", "tail").agg(
        F.min_by("key", F.struct(F.coalesce("rows", F.lit(0)), "key")).alias("key"))
    rows = keyed(F.struct(*df.columns).alias("_row"), value.alias("_value"))
    ends = F.startswith("_value", "head") & F.endswith("_value", "tail")
    rarest = staging.stage(rarest, "rarest")
    # rows repeat by key, which their planned size does not tell, so they are never the side to broadcast
    rarest = F.broadcast(rarest) if sizes.few_rows(rarest, MOST_BROADCAST_PATTERNS) else rarest.hint("merge")
    met = rows.join(rarest, "key").where(F.when(ends, F.like(F.col("_value"), text.like_patterns(F.col("pattern")))))
    return met.select("_row.*", "pattern")


# Comments outside quotes, and what may stand for a table name.
COMMENTS = r"""('[^']*+(?:''[^']*+)*+'?+|"[^"]*+(?:""[^"]*+)*+"?+)|--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"""
NAME = r"`?[A-Za-z_][A-Za-z0-9_]*`?(?:\.`?[A-Za-z_][A-Za-z0-9_]*`?)?"
DML = ("SELECT", "INSERT", "UPDATE", "DELETE")
DDL = ("CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME")


def strip_comments(c: Column) -> Column:
    """SQL text without comments; what looks like one inside quotes stays."""
    marked = F.contains(c, F.lit("--")) | F.contains(c, F.lit("/*"))
    return F.when(marked, F.regexp_replace(c, COMMENTS, "$1")).otherwise(c)


def statement_table(c: Column) -> Column:
    """Table a statement reads or writes, without quotes; none for DDL."""
    lead = r"(?is)^\s*(?:SELECT\b.*?\bFROM|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+"
    found = F.regexp_extract(c, rf"{lead}({NAME})", 1)
    return F.when(found != "", F.replace(found, F.lit("`"), F.lit("")))


def statement_audit(df: DataFrame, column: str) -> DataFrame:
    """Statements per kind and table."""
    plain = df.select(strip_comments(F.col(column)).alias("_s"))
    # a column of its own, so that the pattern is matched once per row
    worded = plain.withColumn("_word", F.upper(F.regexp_extract("_s", r"^\s*([A-Za-z]+)", 1)))
    kind = (
        F.when(F.col("_word").isin(*DDL), F.lit("DDL")).when(F.col("_word").isin(*DML), F.col("_word"))
        .otherwise(F.lit("other"))
    )
    return (
        worded.groupBy(kind.alias("kind"), statement_table(F.col("_s")).alias("table_name"))
        .agg(F.count(F.lit(1)).alias("statements"))
    )


#: Characters that part statements, and stand-ins for them inside quotes.
HELD, MASKS = ", \t\r\n()", "\ue000\ue001\ue002\ue003\ue004\ue005\ue006"


#: A quoted part, an unquoted stretch, or a quote that nothing closes. In '...'
#: and "..." a backslash takes the next character with it; a doubled quote is one.
_PIECES = (
    r"""'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|`[^`]*+(?:``[^`]*+)*+`|[^'"`]++|['"`]""")


def _mask_quoted(text: Column) -> Column:
    """Stand-ins for what parts a statement, inside quotes of any kind only."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(f"(?s){_PIECES}"), F.lit(0)),
        lambda piece: F.when(F.left(piece, F.lit(1)).isin("'", '"', "`"), F.translate(piece, HELD, MASKS)).otherwise(piece))
    return F.array_join(pieces, "")


def ddl_operations(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per operation of each ALTER statement.

    Commas inside one level of brackets or inside quotes do not split, and quoted
    blanks stay as they are. An index is told from a column by its
    leading words, not by a name that contains them. A table rename is marked
    as unsupported.
    """
    body = F.trim(F.regexp_replace(_mask_quoted(strip_comments(F.col(column))), r"\s+", " "))
    head = rf"(?i)^ALTER TABLE ({NAME}) (.*)$"
    full = F.replace(F.regexp_extract(body, head, 1), F.lit("`"), F.lit(""))
    dotted = F.contains(full, F.lit("."))
    parts = df.select(
        *keep,
        F.when(dotted, F.substring_index(full, ".", 1)).alias("database_name"),
        F.when(dotted, F.substring_index(full, ".", -1)).otherwise(full).alias("table_name"),
        F.posexplode(F.split(F.regexp_extract(body, head, 2), r",(?![^(]*[)])")).alias("op_no", "_op"),
    ).withColumn("_op", F.trim("_op"))
    op = F.col("_op")

    def is_(pattern: str) -> Column:
        return op.rlike(rf"(?i)^{pattern}")

    kinds = [
        (r"ADD (CONSTRAINT \S+ )?PRIMARY KEY\b", "AddPrimaryKey"),
        (r"ADD (CONSTRAINT \S+ )?FOREIGN KEY\b", "AddForeignKey"),
        (r"ADD (CONSTRAINT \S+ )?UNIQUE\b", "AddUniqueKey"),
        (r"ADD (INDEX|KEY)\b", "AddIndex"),
        (r"ADD (COLUMN )?", "AddColumn"),
        (r"DROP PRIMARY KEY\b", "DropPrimaryKey"),
        (r"DROP FOREIGN KEY\b", "DropForeignKey"),
        (r"DROP (INDEX|KEY)\b", "DropIndex"),
        (r"DROP (COLUMN )?", "DropColumn"),
        (r"MODIFY (COLUMN )?", "ModifyColumn"),
        (r"CHANGE (COLUMN )?", "ChangeColumn"),
        (r"ALTER (COLUMN )?", "AlterColumn"),
        (r"RENAME COLUMN\b", "RenameColumn"),
        (r"RENAME (INDEX|KEY)\b", "RenameIndex"),
        (r"RENAME\b", "RenameTable"),
        (r"ENGINE\b", "EngineChange"),
        (r"AUTO_INCREMENT\b", "AutoIncrementChange"),
        (r"(DEFAULT )?(CHARACTER SET|CHARSET)\b", "CharsetChange"),
        (r"(DEFAULT )?COLLATE\b", "CollationChange"),
        (r"COMMENT\b", "CommentChange"),
    ]
    kind = F.lit("Unknown")
    for pattern, label in reversed(kinds):
        kind = F.when(is_(pattern), F.lit(label)).otherwise(kind)
    parts = parts.withColumn("kind", kind)

    def take(pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract(op, f"(?i){pattern}", group)
        return F.when(found != "", F.replace(found, F.lit("`"), F.lit("")))

    one = r"`?([A-Za-z_][A-Za-z0-9_]*)`?"
    column_kinds = F.col("kind").isin("AddColumn", "ModifyColumn", "AlterColumn")
    two_names = F.col("kind").isin("ChangeColumn", "RenameColumn", "RenameIndex")
    name = (
        F.when(column_kinds, take(rf"^\w+ (?:COLUMN )?{one}"))
        .when(F.col("kind") == "DropColumn", take(rf"^DROP (?:COLUMN )?{one}"))
        .when(F.col("kind") == "ChangeColumn", take(rf"^CHANGE (?:COLUMN )?{one} {one}", 2))
        .when(F.col("kind").isin("RenameColumn", "RenameIndex"), take(rf"^RENAME \w+ {one} TO {one}", 2))
        .when(F.col("kind").isin("AddIndex", "AddUniqueKey"), take(rf"(?:INDEX|KEY|UNIQUE) {one} ?\("))
        .when(F.col("kind") == "DropIndex", take(rf"^DROP \w+ {one}"))
        .when(F.col("kind") == "EngineChange", take(rf"^ENGINE ?=? ?{one}"))
        .when(F.col("kind") == "RenameTable", take(rf"^RENAME (?:TO |AS )?{one}"))
    )
    old = (
        F.when(F.col("kind") == "ChangeColumn", take(rf"^CHANGE (?:COLUMN )?{one} {one}"))
        .when(two_names, take(rf"^RENAME \w+ {one} TO"))
    )
    place = r"(?: (?:FIRST|AFTER \S+))?$"
    definition = (
        F.when(F.col("kind").isin("AddColumn", "ModifyColumn"), take(rf"^\w+ (?:COLUMN )?{one} (.*?){place}", 2))
        .when(F.col("kind") == "ChangeColumn", take(rf"^CHANGE (?:COLUMN )?{one} {one} (.*?){place}", 3))
        .when(F.col("kind").isin("AddIndex", "AddUniqueKey", "AddPrimaryKey"), take(r"\(([^)]*)\)"))
    )
    positioned = F.col("kind").isin("AddColumn", "ModifyColumn", "ChangeColumn")
    return parts.select(
        *keep, "database_name", "table_name", "op_no", "kind",
        name.alias("name"), old.alias("old_name"), F.translate(definition, MASKS, HELD).alias("definition"),
        (positioned & is_(r".* FIRST$")).alias("is_first"),
        F.when(positioned, take(rf" AFTER {one}$")).alias("after_column"),
        (F.col("kind") != "RenameTable").alias("supported"),
    )


# Character sets with their ids and default collations.
CHARSETS = {
    "utf8mb4": (255, "utf8mb4_general_ci"), "utf8": (33, "utf8_general_ci"),
    "latin1": (8, "latin1_swedish_ci"), "binary": (63, "binary"),
}


def charset_id(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (number, _) in CHARSETS.items():
        out = F.when(F.lower(c) == name, number).otherwise(out)
    return out


def default_collation(c: Column) -> Column:
    out = F.lit("")
    for name, (_, collation) in CHARSETS.items():
        out = F.when(F.lower(c) == name, F.lit(collation)).otherwise(out)
    return out


def utf8_audit(df: DataFrame, data: str, by: Sequence[str], charset: Column) -> DataFrame:
    """Valid and repaired bytes per group, with the declared character set."""
    s = F.col(data).cast("string")
    repaired = F.make_valid_utf8(s)
    return (
        df.select(*by, charset.alias("charset"), F.is_valid_utf8(s).alias("_ok"), F.char_length(repaired).alias("_n"))
        .groupBy(*by, "charset")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("_ok").alias("valid_rows"),
            F.sum(F.col("_n").cast("bigint")).alias("repaired_chars"),
        )
        .select("*", charset_id(F.col("charset")).alias("charset_id"), default_collation(F.col("charset")).alias("collation"))
    )


def endpoint_inventory(df: DataFrame, column: str) -> DataFrame:
    """Distinct ``host:port`` endpoints in order; bad ones are dropped.

    A host has at most 65535 ports, so its window is small however often an
    endpoint occurs.
    """
    parts = text.split_char(F.col(column), ":")
    parsed = df.where(F.size(parts) == 2).select(
        text.trim(F.element_at(parts, 1)).alias("host"), numbers.parse_uint16(F.element_at(parts, 2)).alias("port")
    )
    known = parsed.where((F.col("host") != "") & (F.col("port") > 0)).distinct()
    host = W.partitionBy("host")
    return known.select(
        "host", "port",
        F.count(F.lit(1)).over(host).alias("ports_of_host"),
        (F.row_number().over(host.orderBy("port")) == 1).alias("first_of_host"),
    ).orderBy("host", "port")


def version_number(c: Column) -> Column:
    """``10.5.8-MariaDB`` as 100508; NULL without a leading number."""
    digits = F.regexp_extract(text.trim(c), r"^[0-9.]*", 0)
    def piece(i: int) -> Column:
        return F.coalesce(coords.as_unsigned(F.split_part(digits, F.lit("."), F.lit(i))), F.lit(0))
    return F.when(digits != "", piece(1) * 10000 + piece(2) * 100 + piece(3)).cast("bigint")


def version_vendor(c: Column) -> Column:
    low = text.lower_ascii(c)
    return (
        F.when(F.contains(low, F.lit("percona")), F.lit("percona"))
        .when(F.contains(low, F.lit("mariadb")), F.lit("mariadb")).otherwise(F.lit("mysql"))
    )


def version_rank(df: DataFrame, column: str) -> DataFrame:
    """Oldest and newest version per vendor."""
    c = F.col(column)
    ranked = df.select(c.alias("version"), version_number(c).alias("number"), version_vendor(c).alias("vendor"))
    return ranked.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("servers"),
        F.count("number").alias("with_number"),
        F.min("number").alias("oldest_number"),
        F.max("number").alias("newest_number"),
        F.min_by("version", F.when(F.col("number").isNotNull(), F.struct("number", "version"))).alias("oldest"),
    )


def time_columns(df: DataFrame, ts: str, keep: Sequence[str], moment: Column) -> DataFrame:
    """Every time helper applied to one column; ``moment`` is compared with it."""
    c = F.col(ts)
    parts = ("year", "month", "day", "hour", "minute", "second", "millisecond")
    return sizes.spread(df, list(keep)).select(
        *keep,
        times.to_unix(c).alias("unix_s"),
        times.to_unix_millis(c).alias("unix_ms"),
        times.to_unix_micros(c).alias("unix_us"),
        times.from_unix(times.to_unix(c)).alias("from_s"),
        times.from_unix_millis(times.to_unix_millis(c)).alias("from_ms"),
        times.from_unix_micros(times.to_unix_micros(c)).alias("from_us"),
        times.format_time(c, "yyyy/MM/dd HH").alias("formatted"),
        times.format_iso(c).alias("iso"),
        times.format_iso_utc(c).alias("iso_utc"),
        times.format_iso_millis(c).alias("iso_ms"),
        times.format_mysql(c).alias("mysql_text"),
        times.format_mysql_micros(c).alias("mysql_micros"),
        times.parse_time(times.format_time(c, "yyyy/MM/dd HH"), "yyyy/MM/dd HH").alias("parsed_time"),
        times.parse_iso(times.format_iso(c)).alias("parsed_iso"),
        times.parse_iso(times.format_iso_utc(c)).alias("parsed_iso_utc"),
        times.parse_iso(times.format_time(c, "yyyy/MM/dd HH")).alias("parsed_bad"),
        times.parse_mysql(times.format_mysql(c)).alias("parsed_mysql"),
        times.parse_mysql(times.format_mysql_micros(c)).alias("parsed_micros"),
        *[times.part(c, p).alias(f"{p}_part") for p in parts],
        times.add_seconds(c, 90).alias("plus_90s"),
        times.add_minutes(c, -5).alias("minus_5m"),
        times.add_hours(c, 3).alias("plus_3h"),
        times.add_days(c, 2).alias("plus_2d"),
        (c < moment).alias("is_before"),
        (c > moment).alias("is_after"),
        times.seconds_between(c, moment).alias("seconds_to"),
    )


def duration_text(
    df: DataFrame, key: str, ts: str, order: str, max_group_rows: int = skew.MAX_GROUP_ROWS
) -> DataFrame:
    """Time since the row before it of the same key, as text in three forms."""
    seg = skew.segment(df, [key], [ts, order], max_group_rows)
    rows = skew.last_before(seg, F.col(ts), "_previous").done()
    # the first row of a key has waited -1 seconds
    gap = F.coalesce(times.seconds_between(F.col("_previous"), F.col(ts)), F.lit(-1.0))
    return rows.withColumn("seconds", gap).select(
        *df.columns, "seconds",
        times.format_duration(F.col("seconds")).alias("short_text"),
        times.format_duration_human(F.col("seconds")).alias("human_text"),
        times.format_duration_precise(F.col("seconds")).alias("precise_text"),
    )
