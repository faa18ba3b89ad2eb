"""Column library queries."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changelog, columns as op
from ..session import wide_results
from ..sources.tables import table
from ..sources.views import view, with_views
from .changelog import COLS, KEY, rows

_LOW, _UP = "'abcdefghijklmnopqrstuvwxyz'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_NEEDLE = "the"


def text_columns(spark, d):
    wide_results(spark)  # thirteen columns hold the text again
    label = text.fill("{0}-{1}/{0}", F.col("lang"), F.col("source"))
    return op.text_columns(table(spark, d, "documents"), "text", ["doc_id"], _NEEDLE, label)


TEXT_COLUMNS = f"""
WITH t AS (SELECT *, translate(text, {_UP}, {_LOW}) AS low, instr(text, '{_NEEDLE}') AS spot,
 CASE WHEN contains(text, '{_NEEDLE}') THEN length(text) - instr(reverse(text), reverse('{_NEEDLE}')) - {len(_NEEDLE) - 2} ELSE 0 END AS back FROM documents)
SELECT doc_id, trim(text, {_BLANKS}) AS trimmed, ltrim(text, {_BLANKS}) AS trimmed_left, rtrim(text, {_BLANKS}) AS trimmed_right,
 trim(text, '.E') AS trimmed_chars, translate(text, {_LOW}, {_UP}) AS upper, low AS lower,
 translate(substr(text, 1, 1), {_LOW}, {_UP}) || translate(substr(text, 2), {_UP}, {_LOW}) AS capitalized,
 contains(text, '{_NEEDLE}') AS has, contains(low, '{_NEEDLE}') AS has_any_case, starts_with(text, '{_NEEDLE}') AS starts,
 starts_with(low, '{_NEEDLE}') AS starts_any_case, ends_with(text, '{_NEEDLE}') AS ends, ends_with(low, '{_NEEDLE}') AS ends_any_case,
 CAST(spot - 1 AS INTEGER) AS found_at, CAST(instr(low, '{_NEEDLE}') - 1 AS INTEGER) AS found_any_case,
 CASE WHEN spot > 0 THEN substr(text, 1, spot - 1) || '<1>' || substr(text, spot + 3) ELSE text END AS replaced_first,
 replace(text, '{_NEEDLE}', '<*>') AS replaced_all,
 CASE WHEN back > 0 THEN substr(text, 1, back - 1) || '<n>' || substr(text, back + 3) ELSE text END AS replaced_last,
 CASE WHEN length(text) >= 300 THEN text ELSE repeat('.', 300 - length(text)) || text END AS padded_left,
 CASE WHEN length(text) >= 300 THEN text ELSE text || repeat('.', 300 - length(text)) END AS padded_right,
 repeat(substr(text, 1, 5), 3) AS repeated, substr(text, 6, 20) AS middle, substr(text, 1, 10) AS taken, substr(text, 11) AS dropped,
 text = '' AS empty, trim(text, {_BLANKS}) = '' AS blank, lang || '-' || source || '/' || lang AS label FROM t
"""


def split_join_rows(spark, d):
    return op.split_join_rows(table(spark, d, "documents"), "text", ["doc_id"])


SPLIT_JOIN_ROWS = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
m AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM l),
e AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM m),
f AS (SELECT doc_id, CAST(n AS INTEGER) AS line_no, rtrim(line, chr(13) || chr(10)) AS line FROM e),
w AS (SELECT *, string_split(line, ' ') AS raw FROM f),
x AS (SELECT * EXCLUDE (raw), CASE WHEN raw[-1] = '' THEN raw[:len(raw) - 1] ELSE raw END AS ws FROM w)
SELECT doc_id, line_no, line, CAST(len(ws) AS INTEGER) AS words, CAST(len(string_split(line, '. ')) AS INTEGER) AS sentences,
 CAST(length(line) AS INTEGER) AS characters, array_to_string(ws, '|') AS joined FROM x
"""

NUMBER_TEXT = """
SELECT c_custkey, CASE c_custkey % 12
 WHEN 0 THEN ' ' || CAST(c_custkey AS STRING) || ' ' WHEN 1 THEN '-' || CAST(c_custkey AS STRING) WHEN 2 THEN c_name
 WHEN 3 THEN CAST(c_acctbal AS STRING) WHEN 4 THEN CAST(c_custkey * 10000019 AS STRING) WHEN 5 THEN '+' || CAST(c_nationkey AS STRING)
 WHEN 6 THEN CAST(c_custkey AS STRING) || 'e2' WHEN 7 THEN '' WHEN 8 THEN CAST(c_custkey AS STRING) || 'x'
 WHEN 9 THEN CAST(c_custkey + 65000 AS STRING) WHEN 10 THEN '184467440737095516' || CAST(c_custkey % 100 AS STRING) ELSE '.5' END AS t FROM customer
"""


def parse_numbers(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return op.parse_numbers(spark.sql(NUMBER_TEXT), "t", ["c_custkey"])


PARSE_NUMBERS = f"""
WITH n AS ({NUMBER_TEXT}), s AS (SELECT *, trim(t) AS b FROM n),
v AS (SELECT *, regexp_full_match(b, '[+-]?[0-9]+') AS whole, TRY_CAST(CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN ltrim(b, '+') END AS HUGEINT) AS h,
 TRY_CAST(CASE WHEN regexp_full_match(b, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN ltrim(b, '+') END AS DOUBLE) AS f FROM s)
SELECT c_custkey, TRY_CAST(h AS INTEGER) AS int32, TRY_CAST(h AS BIGINT) AS int64,
 CASE WHEN h BETWEEN 0 AND 65535 THEN CAST(h AS INTEGER) END AS uint16, CASE WHEN h BETWEEN 0 AND 4294967295 THEN CAST(h AS BIGINT) END AS uint32,
 CAST(TRY_CAST(h AS UBIGINT) AS VARCHAR) AS uint64, f AS double_value, CAST(f AS FLOAT) AS float_value, printf('%.2f', f) AS two_places,
 CASE WHEN f IS NOT NULL THEN 'true' ELSE 'false' END AS is_number, lower(hex(t)) AS hex_text, t AS unhexed FROM v
"""


def escape_columns(spark, d):
    return op.escape_columns(table(spark, d, "documents"), "text", ["doc_id"], F.concat("lang", F.lit("`"), "source"))


def _replaces(c, pairs):
    for old, new in pairs:
        c = f"replace({c}, {old}, {new})"
    return c


_SLASH = [("chr(92)", "chr(92) || chr(92)")]
_LINES = [("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")]
_QUOTE = [("'\"'", "chr(92) || '\"'")]
_SQL = _replaces("text", _SLASH + [("''''", "''''''")] + _QUOTE + _LINES)
_JSON = _replaces(
    "text",
    _SLASH + _QUOTE + _LINES + [("chr(8)", "chr(92) || 'b'"), ("chr(12)", "chr(92) || 'f'")]
    + [(f"chr({n})", f"chr(92) || 'u{n:04x}'") for n in range(1, 32) if n not in (8, 9, 10, 12, 13)],
)
ESCAPE_COLUMNS = f"""
SELECT doc_id, {_SQL} AS sql_escaped, '''' || {_SQL} || '''' AS sql_quoted, '`' || lang || '``' || source || '`' AS identifier,
 {_JSON} AS json_escaped, text AS json_round_trip, lang || '``' || source AS plain_name,
 '`shop`.`' || lang || '``' || source || '`' AS full_name FROM documents
"""

PATTERNS = ["small*", "*widget", "r?d *", "*in?", "*", "blue ring"]


def wildcard_match(spark, d):
    return op.wildcard_match(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", PATTERNS)


WILDCARD_MATCH = "SELECT p_partkey, p_name, p AS pattern FROM part, (VALUES " + ", ".join(
    f"('{p}', '{p.replace('*', '.*').replace('?', '.')}')" for p in PATTERNS
) + ") v(p, r) WHERE regexp_full_match(p_name, r, 's')"


_NAME_PATTERNS = """
SELECT CASE c_custkey % 5 WHEN 0 THEN '*' || right(c_name, 4) WHEN 1 THEN left(c_name, 14) || '*' WHEN 2 THEN left(c_name, 13) || '??' || right(c_name, 1)
 WHEN 3 THEN c_name ELSE '*' || substring(c_name, 11, 3) || '*' || right(c_name, 2) END AS pattern FROM customer WHERE c_custkey % 3 = 0
"""


def wildcard_join(spark, d):
    """Names against patterns that are made of every third name."""
    names = table(spark, d, "customer")
    names.createOrReplaceTempView("customer")
    return op.wildcard_join(names.select("c_custkey", "c_name"), "c_name", spark.sql(_NAME_PATTERNS))


WILDCARD_JOIN = f"""
SELECT c_custkey, c_name, pattern FROM customer
JOIN (SELECT DISTINCT pattern FROM ({_NAME_PATTERNS})) ON c_name LIKE translate(pattern, '*?', '%_')
"""


def statements(spark, d):
    """Change statements and ALTERs with comments in and around them."""
    changes = changelog.change_statements(rows(spark, d), KEY, COLS).select(
        F.concat(F.lit("/* '"), F.col("pos").cast("string"), F.lit("' */ "), F.replace("stmt", F.lit("'U'"), F.lit("'-- U'")), F.lit(" -- done; DROP\n")).alias("stmt")
    )
    ddl = view(spark, d, "ddl_log").select(F.concat(F.lit("-- change\n"), F.col("stmt")).alias("stmt"))
    reads = table(spark, d, "orders").select(
        F.concat(F.lit("select '/*' || o_custkey FROM shop.orders where o_orderkey = "), F.col("o_orderkey").cast("string")).alias("stmt")
    )
    return changes.unionByName(ddl).unionByName(reads)


def statement_audit(spark, d):
    return op.statement_audit(statements(spark, d), "stmt")


STATEMENT_AUDIT = with_views("row_log ddl_log", """
SELECT CASE event_type WHEN 'WriteRows' THEN 'INSERT' WHEN 'UpdateRows' THEN 'UPDATE' ELSE 'DELETE' END AS kind, 'shop.orders' AS table_name, count(*) AS statements FROM row_log GROUP BY ALL
UNION ALL SELECT 'DDL', NULL, count(*) FROM ddl_log UNION ALL SELECT 'SELECT', 'shop.orders', count(*) FROM orders
""")


def ddl_operations(spark, d):
    return op.ddl_operations(view(spark, d, "ddl_log"), "stmt", ["stmt_id"])


DDL_OPERATIONS = with_views("ddl_log", """
SELECT stmt_id, 'shop' AS database_name, 't_' || stmt_id AS table_name, CAST(op_no AS INTEGER) AS op_no, kind, name, old_name, definition, is_first, after_column, kind <> 'RenameTable' AS supported
FROM ddl_log JOIN (VALUES
 (0,0,'AddColumn','c1',NULL,'INT',FALSE,NULL), (1,0,'AddColumn','c2',NULL,'VARCHAR(255) NOT NULL',FALSE,'c1'),
 (2,0,'DropColumn','c3',NULL,NULL,FALSE,NULL), (3,0,'DropColumn','c4',NULL,NULL,FALSE,NULL),
 (4,0,'ModifyColumn','c5',NULL,'DECIMAL(10,2)',FALSE,NULL), (5,0,'ChangeColumn','c7','c6','BIGINT',FALSE,NULL),
 (6,0,'AddIndex','idx_a',NULL,'c1, c2',FALSE,NULL), (7,0,'AddUniqueKey','uk_b',NULL,'c2',FALSE,NULL),
 (8,0,'AddPrimaryKey',NULL,NULL,'id',FALSE,NULL), (9,0,'DropPrimaryKey',NULL,NULL,NULL,FALSE,NULL),
 (10,0,'DropIndex','idx_a',NULL,NULL,FALSE,NULL), (11,0,'EngineChange','InnoDB',NULL,NULL,FALSE,NULL),
 (12,0,'RenameTable','t_new',NULL,NULL,FALSE,NULL), (13,0,'AddColumn','c8',NULL,'INT',TRUE,NULL),
 (13,1,'DropColumn','c9',NULL,NULL,FALSE,NULL), (13,2,'AddIndex','idx_c',NULL,'c1, c2',FALSE,NULL),
 (14,0,'CommentChange',NULL,NULL,NULL,FALSE,NULL), (15,0,'RenameColumn','c11','c10',NULL,FALSE,NULL),
 (16,0,'AddColumn','user_key',NULL,'INT',FALSE,NULL), (17,0,'ModifyColumn','c12',NULL,'TIMESTAMP NOT NULL',FALSE,NULL),
 (18,0,'ChangeColumn','c14','c13','INT UNSIGNED',FALSE,NULL),
 (19,0,'AddColumn','c15',NULL,'INT COMMENT "x,y (z"',FALSE,NULL), (19,1,'DropColumn','c16',NULL,NULL,FALSE,NULL),
 (20,0,'AddColumn','c17',NULL,'VARCHAR(9) DEFAULT ''it' || chr(92) || '''s, ok''',FALSE,NULL), (20,1,'DropColumn','c18',NULL,NULL,FALSE,NULL)
) v(shape, op_no, kind, name, old_name, definition, is_first, after_column) ON stmt_id % 21 = shape
""")


def utf8_audit(spark, d):
    """Document bytes; those not in English end in a broken character."""
    whole = F.col("text").cast("binary")
    broken = F.when(F.col("lang") == "en", whole).otherwise(F.concat(whole, F.unhex(F.lit("C328"))))
    docs = table(spark, d, "documents").select("lang", broken.alias("data"))
    charset = F.when(F.col("lang") == "en", F.lit("latin1")).otherwise(F.lit("UTF8MB4"))
    return op.utf8_audit(docs, "data", ["lang"], charset)


UTF8_AUDIT = """
SELECT lang, CASE WHEN lang = 'en' THEN 'latin1' ELSE 'UTF8MB4' END AS charset, count(*) AS "rows", count(*) FILTER (WHERE lang = 'en') AS valid_rows,
 CAST(sum(length(text) + CASE WHEN lang = 'en' THEN 0 ELSE 2 END) AS BIGINT) AS repaired_chars,
 CASE WHEN lang = 'en' THEN 8 ELSE 255 END AS charset_id, CASE WHEN lang = 'en' THEN 'latin1_swedish_ci' ELSE 'utf8mb4_general_ci' END AS collation
FROM documents GROUP BY lang
"""


def endpoint_inventory(spark, d):
    return op.endpoint_inventory(view(spark, d, "endpoints"), "endpoint")


ENDPOINT_INVENTORY = with_views("endpoints", """
WITH p AS (SELECT DISTINCT trim(split_part(endpoint, ':', 1)) AS host, TRY_CAST(split_part(endpoint, ':', 2) AS INTEGER) AS port FROM endpoints WHERE contains(endpoint, ':'))
SELECT host, port, count(*) OVER (PARTITION BY host) AS ports_of_host, row_number() OVER (PARTITION BY host ORDER BY port) = 1 AS first_of_host
FROM p WHERE port > 0 AND host <> ''
""")

VERSION_TEXT = """
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '10.' || CAST(s_nationkey AS STRING) || '.8-MariaDB' WHEN 1 THEN '5.7.' || CAST(s_suppkey % 50 AS STRING)
 WHEN 2 THEN ' 8.0.' || CAST(s_nationkey AS STRING) || '-Percona' WHEN 3 THEN '8.0' WHEN 4 THEN 'none' ELSE '10.11' || '-mariadb-log' END AS v FROM supplier
"""


def version_rank(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return op.version_rank(spark.sql(VERSION_TEXT), "v")


VERSION_RANK = f"""
WITH t AS ({VERSION_TEXT}), n AS (SELECT v, regexp_extract(trim(v), '^[0-9.]*') AS d,
 CASE WHEN contains(lower(v), 'percona') THEN 'percona' WHEN contains(lower(v), 'mariadb') THEN 'mariadb' ELSE 'mysql' END AS vendor FROM t),
r AS (SELECT v, vendor, CASE WHEN d <> '' THEN coalesce(TRY_CAST(split_part(d, '.', 1) AS BIGINT), 0) * 10000
 + coalesce(TRY_CAST(split_part(d, '.', 2) AS BIGINT), 0) * 100 + coalesce(TRY_CAST(split_part(d, '.', 3) AS BIGINT), 0) END AS number FROM n)
SELECT vendor, count(*) AS servers, count(number) AS with_number, min(number) AS oldest_number, max(number) AS newest_number,
 first(v ORDER BY number, v) FILTER (WHERE number IS NOT NULL) AS oldest FROM r GROUP BY vendor
"""

_MOMENT = "2024-01-16 00:00:00"


def time_columns(spark, d):
    moment = F.lit(_MOMENT).cast("timestamp_ntz")
    return op.time_columns(table(spark, d, "events"), "ts", ["event_id"], moment)


TIME_COLUMNS = f"""
WITH e AS (SELECT event_id, ts, date_trunc('second', ts) AS s, TIMESTAMP '{_MOMENT}' AS m FROM events)
SELECT event_id, epoch_us(ts) // 1000000 AS unix_s, epoch_us(ts) // 1000 AS unix_ms, epoch_us(ts) AS unix_us,
 s AS from_s, date_trunc('millisecond', ts) AS from_ms, ts AS from_us, strftime(ts, '%Y/%m/%d %H') AS formatted,
 strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_utc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+0000') AS iso_ms,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS mysql_text, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS mysql_micros, date_trunc('hour', ts) AS parsed_time,
 s AS parsed_iso, s AS parsed_iso_utc, CAST(NULL AS TIMESTAMP) AS parsed_bad, s AS parsed_mysql, ts AS parsed_micros,
 CAST(year(ts) AS INTEGER) AS year_part, CAST(month(ts) AS INTEGER) AS month_part, CAST(day(ts) AS INTEGER) AS day_part, CAST(hour(ts) AS INTEGER) AS hour_part,
 CAST(minute(ts) AS INTEGER) AS minute_part, CAST(second(ts) AS INTEGER) AS second_part, CAST((epoch_us(ts) // 1000) % 1000 AS INTEGER) AS millisecond_part,
 ts + INTERVAL 90 SECOND AS plus_90s, ts - INTERVAL 5 MINUTE AS minus_5m, ts + INTERVAL 3 HOUR AS plus_3h, ts + INTERVAL 2 DAY AS plus_2d,
 ts < m AS is_before, ts > m AS is_after, (epoch_us(m) - epoch_us(ts)) / 1000000.0::DOUBLE AS seconds_to FROM e
"""


def duration_text(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return op.duration_text(events, "user_id", "ts", "event_id")


DURATION_TEXT = """
WITH g AS (SELECT event_id, user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE, -1.0::DOUBLE) AS seconds FROM events),
i AS (SELECT *, CAST(floor(seconds) AS BIGINT) AS t, CAST(floor(seconds * 1000) AS BIGINT) AS ms FROM g)
SELECT event_id, user_id, ts, seconds,
 CASE WHEN seconds < 0 THEN '0s' WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's'
  WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS short_text,
 CASE WHEN seconds < 0 THEN '0s' WHEN seconds < 1 THEN ms || 'ms' WHEN t >= 86400 THEN (t // 86400) || 'd ' || (t % 86400 // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's'
  WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's' WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS human_text,
 CASE WHEN seconds < 0 THEN '0s' ELSE (ms // 1000) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 's' END AS precise_text FROM i
"""

QUERIES = {
    "text_columns": (text_columns, TEXT_COLUMNS),
    "split_join_rows": (split_join_rows, SPLIT_JOIN_ROWS),
    "parse_numbers": (parse_numbers, PARSE_NUMBERS),
    "escape_columns": (escape_columns, ESCAPE_COLUMNS),
    "wildcard_match": (wildcard_match, WILDCARD_MATCH),
    "wildcard_join": (wildcard_join, WILDCARD_JOIN),
    "statement_audit": (statement_audit, STATEMENT_AUDIT),
    "ddl_operations": (ddl_operations, DDL_OPERATIONS),
    "utf8_audit": (utf8_audit, UTF8_AUDIT),
    "endpoint_inventory": (endpoint_inventory, ENDPOINT_INVENTORY),
    "version_rank": (version_rank, VERSION_RANK),
    "time_columns": (time_columns, TIME_COLUMNS),
    "duration_text": (duration_text, DURATION_TEXT),
}
