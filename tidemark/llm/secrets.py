"""Secrets in texts, told from copied examples by who else owns them.

Only DataFrame functions are used. A regular expression's matches and the
pieces between them, in turn, give each match its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

#: Kinds in the order in which ties are listed. The first three are the base;
#: the last is kept only where ownership makes it live-looking.
KINDS = ("assign", "access", "hex", "token")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"[A-Za-z0-9_-]{20,}",
}
#: Cheap tests that a text with a match passes.
HINTS = {
    "assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{24}", "token": r"[A-Za-z0-9_-]{20}",
}
#: Characters of an assigned value.
LEAST_VALUE = 6
#: Owners, or repositories of few owners, from which on a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 25
#: Different characters of a live-looking value, and words of made-up ones.
LEAST_CHARACTERS = 8
MADE_UP = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|12345678"


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, kind number, end, value) of a kind's matches in a text."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    gaps = F.slice(F.transform(F.split(text, PATTERNS[kind], -1), F.length), 1, F.size(found))
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("length"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + row["length"]
        item = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), row["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    placed = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    if kind == "assign":
        placed = F.filter(placed, lambda m: F.length(m["value"]) >= LEAST_VALUE)
    if kind == "token":
        placed = F.filter(placed, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return F.when(text.rlike(HINTS[kind]), placed).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"])), ",")


def _bare(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))


def candidates(docs: DataFrame, owner: str, repository: str, text_col: str = "text") -> DataFrame:
    """One staged row per input row: a row number, base spans and candidate values.

    Tokens that overlap a base span are left out.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(text_col).alias("_text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
    )
    rows = rows.select("row", "owner", "repository", *(_matches(text, k).alias(k) for k in KINDS))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("row", "owner", "repository", base.alias("base"), "token")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return batches.stage(
        rows.select(F.monotonically_increasing_id().alias("row_no"), "row", "owner", "repository", "base", F.concat("base", free).alias("found")),
        "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, example, live): how many distinct ones hold each candidate value.

    A value is an example if many owners, or many repositories, have it. Any other
    one belongs to its owners, and is live if it looks random.

    Values first meet as (hash, owner, repository), so that a value copied
    everywhere is spread over its owners and counted in parts.
    """
    values = found.select("owner", "repository", F.explode("found").alias("m")).select(
        "owner", "repository", F.sha2("m.value", 256).alias("hash"),
        ((F.size(F.array_distinct(F.split("m.value", ""))) >= LEAST_CHARACTERS) & ~F.col("m.value").rlike(MADE_UP)).alias("random"))
    pairs = values.groupBy("hash", "owner", "repository").agg(F.first("random").alias("random"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.first("random").alias("random"))
    counted = owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.first("random").alias("random"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    return counted.select("hash", "owners", "repositories", example.alias("example"), (F.col("random") & ~example).alias("live"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without the text, and their spans and verdicts.

    New columns: ``base`` and ``spans`` (arrays of start, kind, end, sorted),
    ``n_live`` and ``n_examples``: spans of values that look random and that few
    owners and repositories have, and of values that EXAMPLE_OWNERS or more
    owners, or EXAMPLE_REPOSITORIES or more repositories, have.
    Spans of the kind ``token`` are kept only where live-looking; base spans
    always stay. A null or empty text has no spans. A null owner or repository
    counts as one of its own. Repeated rows are each reported and count as one
    repository. Columns named like the new ones are replaced.
    """
    new = ["base", "spans", "n_live", "n_examples"]
    rows = candidates(docs, owner, repository, text_col)
    values = rows.select("row_no", F.explode("found").alias("m")).select(
        "row_no", "m.start", "m.kind", "m.end", F.sha2("m.value", 256).alias("hash"))
    owned = batches.stage(ownership(rows), "secrets-owned")
    # both sides are plain shuffles, so a value that is everywhere can be split
    judged = values.join(owned, "hash")
    kept = judged.where((F.col("kind") < KINDS.index("token")) | F.col("live"))
    of_row = kept.groupBy("row_no").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_examples"))
    of_row = batches.stage(of_row, "secrets-spans")
    names = [c for c in docs.columns if c != text_col and c not in new]
    base = _bare(F.col("base"))
    return rows.join(batches.broadcast_if_small(of_row), "row_no", "left").select(
        *(F.col("row")[c].alias(c) for c in names), base.alias("base"), F.coalesce("spans", base).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, base counts and digest, all spans, live and example counts of every document."""
    found = scan(batches.table(spark, folder, "documents").select("doc_id", "source", "text"))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_examples")


def _sql_matches(kind: str) -> str:
    """A kind's matches in DuckDB: the same pieces, placed by running sums."""
    pattern = PATTERNS[kind].replace("(?i)(password|passwd|secret|token|api_?key)", "(" + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in "password|passwd|secret|token|api_?key".split("|")) + ")")
    pattern = pattern.replace("'", "''")
    values = f"regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0})"
    keep = {
        "assign": f"length(v) >= {LEAST_VALUE}", "token": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')",
    }.get(kind, "true")
    return f"""
SELECT n, source, doc_id, {KINDS.index(kind)} AS kind, s AS start, s + length(m) AS "end", v FROM (
  SELECT n, source, doc_id, m, v,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(m) AS BIGINT) AS s
  FROM (SELECT n, source, doc_id, gaps, ms, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i
    FROM (SELECT n, source, doc_id, regexp_split_to_array(t, '{pattern}') AS gaps,
      regexp_extract_all(t, '{pattern}') AS ms, {values} AS vs FROM texts)))
WHERE {keep}"""


OP4_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS n, coalesce(source, '') AS source, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_matches(k) for k in KINDS[:3])}),
tokens AS ({_sql_matches("token")}),
free AS (SELECT * FROM tokens t WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.n = t.n AND b.start < t."end" AND t.start < b."end")),
found AS (SELECT * FROM base UNION ALL SELECT * FROM free),
counted AS (SELECT v, count(DISTINCT source) >= {EXAMPLE_OWNERS}
    OR count(DISTINCT (source, coalesce(CAST(doc_id AS VARCHAR), ''))) >= {EXAMPLE_REPOSITORIES} AS example, any_value(len(list_distinct(string_split(v, ''))) >= {LEAST_CHARACTERS}
    AND NOT regexp_matches(lower(v), '{MADE_UP.replace("(?i)", "")}')) AS random FROM found GROUP BY v),
owned AS (SELECT v, example, random AND NOT example AS live FROM counted),
judged AS (SELECT f.*, example, live FROM found f JOIN owned USING (v)),
kept AS (SELECT n, string_agg(CASE WHEN kind < 3 THEN ['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || "end" END, ',' ORDER BY start, kind) AS base_list,
  string_agg(['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_examples
  FROM judged WHERE kind < 3 OR live GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM texts LEFT JOIN kept USING (n)
"""
