"""Text, number and time helpers on known values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text, times
from tidemark.operators import columns


def one(spark, make, value, type="string"):
    return spark.createDataFrame([(value,)], f"v {type}").select(make(F.col("v"))).first()[0]


TEXT = [
    (text.trim, "  hello  ", "hello"), (text.trim, "\t\nhello\n\t", "hello"), (text.trim, "   ", ""),
    (text.upper_ascii, "HeLLo", "HELLO"), (text.lower_ascii, "HeLLo", "hello"), (text.upper_ascii, "aé", "Aé"),
    (text.capitalize, "hELLO", "Hello"), (text.escape_sql, "it's", "it''s"), (text.escape_sql, "hello\nworld", "hello\\nworld"),
    (text.quote_identifier, "table`name", "`table``name`"), (text.normalize_name, " `t` ", "t"), (text.normalize_name, "'t\"", "'t\""),
    (lambda c: text.replace_first(c, "hello", "hi"), "hello hello", "hi hello"),
    (lambda c: text.replace_last(c, "hello", "hi"), "hello hello!", "hello hi!"),
    (lambda c: text.replace_last(c, "x", "hi"), "hello", "hello"),
    (lambda c: text.pad_left(c, 3), "abcd", "abcd"), (lambda c: text.pad_left(c, 6, "0"), "abcd", "00abcd"),
    (lambda c: text.split_char(c, ","), "a,b,c", ["a", "b", "c"]), (lambda c: text.split_char(c, ","), "a,", ["a"]),
    (lambda c: text.split_char(c, ","), "", []), (lambda c: text.split_char(c, "."), "a..", ["a", ""]),
    (lambda c: text.split_text(c, ", "), "a, b, ", ["a", "b", ""]), (lambda c: text.split_text(c, ""), "abc", ["a", "b", "c"]),
    (text.split_lines, "a\r\nb\n", ["a", "b"]), (lambda c: text.find(c, "lo"), "hello", 3), (lambda c: text.find(c, "x"), "hello", -1),
    (text.escape_json, 'a"\\\n\x01', 'a\\"\\\\\\n\\u0001'), (text.unescape_json, 'a\\"\\\\\\n\\u0001', 'a"\\\n\x01'),
    (text.unescape_json, "\\q\\\\n\\u00e9\"", "\\q\\né\""), (text.unescape_json, "x\\", "x\\"),
    (numbers.parse_int64, "12345", 12345), (numbers.parse_int64, " -12345 ", -12345), (numbers.parse_int64, "abc", None),
    (numbers.parse_int64, "12.5", None), (numbers.parse_int32, "3000000000", None), (numbers.parse_uint16, "70000", None),
    (numbers.parse_double, "1e3", 1000.0), (numbers.parse_double, "1d", None), (numbers.from_hex, "6869", "hi"), (numbers.from_hex, "6g", None),
    (columns.strip_comments, "a /* b */ 'c -- d' -- e\nf", "a  'c -- d' \nf"), (columns.strip_comments, "x /* open", "x "),
    (columns.version_number, "10.5.8-MariaDB", 100508), (columns.version_number, "5.7", 50700), (columns.version_number, "x", None),
    (columns.version_vendor, "10.5.8-MariaDB", "mariadb"), (columns.charset_id, "UTF8", 33), (columns.default_collation, "nope", ""),
]


@pytest.mark.parametrize("make,value,want", TEXT)
def test_text(spark, make, value, want):
    assert one(spark, make, value) == want


@pytest.mark.parametrize("value,want", [
    ("SELECT * FROM my_table", ("SELECT", "my_table")), ("insert into d.my_table VALUES (1)", ("INSERT", "d.my_table")),
    ("UPDATE my_table SET col = 1", ("UPDATE", "my_table")), ("DELETE FROM t WHERE id = 1", ("DELETE", "t")),
    ("CREATE TABLE t (id INT)", ("DDL", None)), ("DROP TABLE t", ("DDL", None)), ("SHOW TABLES", ("other", None)),
])
def test_statement_kinds(spark, value, want):
    got = columns.statement_audit(spark.createDataFrame([(value,)], "s string"), "s").first()
    assert (got["kind"], got["table_name"]) == want


def test_ddl_operations(spark):
    stmts = [
        (1, "ALTER TABLE my_table ADD COLUMN new_col INT, DROP COLUMN old_col, ADD INDEX idx_name (col1, col2)"),
        (2, "  ALTER   TABLE   my_db.my_table   ADD   COLUMN   col   VARCHAR(255)  "),
        (3, "ALTER TABLE t RENAME TO new_t"), (4, "ALTER TABLE t ADD COLUMN n INT AFTER existing_col"),
        (5, "ALTER TABLE t MODIFY col VARCHAR(100) NOT NULL FIRST"),
    ]
    df = columns.ddl_operations(spark.createDataFrame(stmts, "id int, s string"), "s", ["id"])
    got = [(r.id, r.kind, r.name, r.definition, r.is_first, r.after_column, r.supported) for r in df.orderBy("id", "op_no").collect()]
    assert got == [
        (1, "AddColumn", "new_col", "INT", False, None, True), (1, "DropColumn", "old_col", None, False, None, True),
        (1, "AddIndex", "idx_name", "col1, col2", False, None, True),
        (2, "AddColumn", "col", "VARCHAR(255)", False, None, True), (3, "RenameTable", "new_t", None, False, None, False),
        (4, "AddColumn", "n", "INT", False, "existing_col", True), (5, "ModifyColumn", "col", "VARCHAR(100) NOT NULL", True, None, True),
    ]


@pytest.mark.parametrize("pattern,yes,no", [("a*c", "abbc", "abb"), ("a?c", "abc", "ac"), ("*", "", None), ("50%_\\", "50%_\\", "50x_\\")])
def test_wildcards(spark, pattern, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "v string")
    assert [r.v for r in columns.wildcard_match(df, "v", [pattern]).collect()] == [yes]


def test_ten_thousand_patterns(spark):
    """Every kind of pattern equals a plain test; no nested-loop join."""
    rng = random.Random(4)
    letters = "abc%_\\.é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(rng.randrange(0, 14)) for _ in range(250)] + [None, "", "two\nlines", "abcabc"]
    made = {"", "*", "?", "???", "?*", "**", "two?lines", "*\n*", "a*", "*é", "ab?*c", "abcabc"}
    while len(made) < 10_000:
        made.add("".join(rng.choice([word(1), word(3), word(4), "*", "?"]) for _ in range(rng.randrange(1, 5))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    patterns = spark.createDataFrame([(p,) for p in [*made, None, "*"]], "p string")
    got = columns.wildcard_join(df, "v", patterns, "p")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    plain = {p: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), re.S) for p in made}
    want = sorted((i, t, p) for i, t in enumerate(texts) if t is not None for p, r in plain.items() if r.fullmatch(t))
    assert sorted(map(tuple, got.collect())) == want
    assert columns.wildcard_join(df, "v", patterns.limit(0), "p").count() == 0


def test_endpoints(spark):
    rows = [("localhost:3306",), ("invalid",), ("localhost:abc",), (" a:3307",), ("a:3306",), ("a:3306",), (":1",), ("b:0",), ("b:70000",), ("b:1:2",)]
    got = [tuple(r) for r in columns.endpoint_inventory(spark.createDataFrame(rows, "e string"), "e").collect()]
    assert got == [("a", 3306, 2, True), ("a", 3307, 2, False), ("localhost", 3306, 1, True)]


@pytest.mark.parametrize("seconds,short,human,precise", [
    (125.5, "2m 5s", "2m 5s", "125.500s"), (0.25, "0s", "250ms", "0.250s"), (-1.0, "0s", "0s", "0s"),
    (90061.0, "25h 1m 1s", "1d 1h 1m 1s", "90061.000s"), (3600.0, "1h 0m 0s", "1h 0m 0s", "3600.000s"),
])
def test_durations(spark, seconds, short, human, precise):
    forms = [times.format_duration, times.format_duration_human, times.format_duration_precise]
    assert [one(spark, f, seconds, "double") for f in forms] == [short, human, precise]


def test_times(spark):
    read = lambda make, v: str(one(spark, make, v))
    assert read(times.parse_mysql, "2024-01-02 03:04:05.5") == "2024-01-02 03:04:05.500000"
    assert read(times.parse_mysql, "2024-01-02T03:04:05") == "None"
    assert read(times.parse_iso, "2024-01-02T03:04:05+0200") == "2024-01-02 01:04:05"
    assert read(times.parse_iso, "2024-01-02T03:04:05") == "2024-01-02 03:04:05"
    assert read(times.parse_iso, "yesterday") == "None"


def test_fixed_places(spark):
    show = lambda v, n: one(spark, lambda c: numbers.to_text(c, n), v, "double")
    values = [1.5, 1.005, 0.125, 12345678.9, -2.5, 2.0**60 + 4096, -(2.0**70)]
    assert [show(v, 2) for v in values] == [f"{v:.2f}" for v in values]


def test_broken_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok"), "a"), (bytearray(b"\xc3("), "a")], "d binary, g string")
    row = columns.utf8_audit(df, "d", ["g"], F.lit("utf8")).first()
    assert (row.rows, row.valid_rows, row.repaired_chars, row.charset_id, row.collation) == (2, 1, 4, 33, "utf8_general_ci")


def test_wildcard_join_finds_patterns_by_their_ends(spark, monkeypatch):
    """Names that share all stretches of a pattern's literal don't meet it if they hold them elsewhere."""
    names = [f"name-{i:05d}" for i in range(300)] + ["ab", "aba", "", "name-00012x"]
    given = [f"name-{i:05d}*" for i in range(0, 300, 7)] + ["*12", "*0*7", "name-0001?", "ab*ba", "a*", "*x", "?b", "*", "*00?00", "00*"]
    staged, stage = [], columns.staging.stage
    monkeypatch.setattr(columns.staging, "stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = sorted((r.v, r.p) for r in columns.wildcard_join(df, "v", spark.createDataFrame([(p,) for p in given], "p string"), "p").selectExpr("v", "pattern p").collect())
    regex = lambda p: "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in p)
    assert got == sorted((n, p) for n in names for p in given if re.fullmatch(regex(p), n))
    keys = {}
    for r in staged[0].collect():
        keys.setdefault(r.pattern, set()).add(r.key)
    assert "^3:8:014" in keys["name-00014*"] and "$2:1:12" in keys["*12"] and "#10" in keys["name-0001?"]


def test_wide_results_take_little_room(spark, tmp_path):
    """The text columns are written in the denser codec, unless the session names another one."""
    from tidemark.catalog import columns as queries

    key, held = "spark.sql.parquet.compression.codec", {}
    before = spark.conf.get(key, None)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "then", "of", "and", "word"]) + str(rng.randrange(500)) for _ in range(300)), "en", "web") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    try:
        for codec in (None, "snappy"):
            spark.conf.set(key, codec) if codec else spark.conf.unset(key)
            queries.text_columns(spark, str(tmp_path)).write.parquet(path := str(tmp_path / str(codec)))
            held[codec] = sum(f.stat().st_size for f in (tmp_path / str(codec)).glob("*.parquet"))
            assert spark.read.parquet(path).count() == 300
        assert held[None] < 0.8 * held["snappy"]
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
