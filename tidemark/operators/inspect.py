"""Table inspection: column profiles, key checks, counts and ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import staging
from ..sources.tables import footer_table


@dataclass(frozen=True)
class KeySpec:
    """A declared key: its name, ordered columns and kind."""

    name: str
    columns: tuple[str, ...]
    primary: bool = False


#: A key is one column name or several.
Key = str | Sequence[str]


def key_columns(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def find_column(df: DataFrame, name: str) -> str | None:
    """The column with this name, ignoring case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, nullable, rows, nulls, distinct, min, max.

    Two narrow passes: plain aggregates, and distinct values as (column number,
    128-bit hash) rows that are combined before the shuffle, so no row is copied
    with all its columns. ``approximate`` keeps to fixed-size sketches instead.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [
            F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"),
            (F.approx_count_distinct(f"`{c}`") if approximate else F.max(F.lit(None).cast("bigint"))).alias(f"d{i}"),
            F.min(f"`{c}`").cast("string").alias(f"lo{i}"),
            F.max(f"`{c}`").cast("string").alias(f"hi{i}"),
        ]
    entries = [
        F.struct(
            F.lit(i).alias("_column"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            F.col("rows"),
            F.col(f"n{i}").alias("nulls"),
            F.col(f"d{i}").alias("distinct_values"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    profile = df.agg(*aggs).select(F.inline(F.array(*entries)))
    if approximate:
        return profile.drop("_column")
    # a row for each column at most
    counted = F.broadcast(_distinct_values(df))
    joined = profile.drop("distinct_values").join(counted, F.col("_column") == F.col("_counted"), "left")
    return joined.select(
        "column_name", "data_type", "nullable", "rows", "nulls", F.coalesce("_distinct", F.lit(0)).alias("distinct_values"),
        "min_value", "max_value",
    )


def _distinct_values(df: DataFrame) -> DataFrame:
    """(_counted, _distinct): distinct values of each column that has any, nulls not counted."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("float", "double"):
            c = c + F.lit(0.0)  # one zero, whatever its sign
        hashed = F.struct(F.lit(i).alias("_counted"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(i), c).alias("b"))
        cells.append(F.when(c.isNotNull(), hashed))
    values = df.select(F.explode(F.array(*cells)).alias("v")).where("v IS NOT NULL").select("v.*").distinct()
    return values.groupBy("_counted").agg(F.count(F.lit(1)).alias("_distinct"))


def key_check(df: DataFrame, keys: Sequence[KeySpec]) -> DataFrame:
    """Per candidate key: rows, distinct, duplicates, NULL rows, usable or not.

    Counting per key value first means a hot value is combined before the
    shuffle. A row with a NULL key part counts as a NULL row only.
    """

    def one(key: KeySpec) -> DataFrame:
        per_value = df.groupBy(*key.columns).agg(F.count(F.lit(1)).alias("_n"))
        missing = _any_null(key.columns)
        return (
            per_value.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.count_if(~missing).alias("distinct_keys"),
                F.coalesce(F.sum(F.when(~missing, F.col("_n") - 1)), F.lit(0)).alias("duplicates"),
                F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("null_rows"),
            )
            .select(
                F.lit(key.name).alias("key_name"),
                "*",
                ((F.col("duplicates") == 0) & (F.col("null_rows") == 0)).alias("usable"),
            )
        )

    return reduce(DataFrame.unionByName, [one(k) for k in keys])


def shared_key(original: DataFrame, shadow: DataFrame, candidates: Sequence[KeySpec]) -> DataFrame:
    """First candidate usable in both tables: primary first, then as declared.

    No row if none is usable.
    """
    present = [
        k
        for k in sorted(candidates, key=lambda k: not k.primary)
        if all(find_column(t, c) for t in (original, shadow) for c in k.columns)
    ]
    spark = original.sparkSession
    # Each check shuffles the key columns of a table, so stop at the first
    # candidate that holds rather than check all of them.
    picked = next((k for k in present if _usable(original, k) and _usable(shadow, k)), None)
    rows = [(picked.name, ",".join(picked.columns), picked.primary)] if picked else []
    return spark.createDataFrame(rows, "key_name string, key_columns string, is_primary boolean")


def _usable(df: DataFrame, key: KeySpec) -> bool:
    return key_check(df, [key]).first()["usable"]


def duplicate_key_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that would break a unique key.

    Repeated values are found by a combined count and joined back, so a hot
    value never sits in one window. NULL keys are not equal to each other.
    """
    repeated = (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    )
    return df.join(repeated, list(key), "left_semi")


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent; a NULL key needs none."""
    parents = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti")


def row_count_exact(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def row_count_estimate(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """Rows of a Parquet table from the footers of some of its files, and the standard error.

    Of up to ``most_files`` files, spread evenly over the table in order of their
    names, the footers tell the rows; the others are taken to hold as many rows
    per byte. No data are read. If these are all files, the count is exact and
    the error 0.
    """
    schema = "estimated_rows bigint, standard_error double"
    files = sorted(spark.read.parquet(path).inputFiles())
    if len(files) <= most_files:
        return spark.createDataFrame([(footer_table(spark, path).count(), 0.0)], schema)
    some = [files[i * len(files) // most_files] for i in range(most_files)]
    bytes_of = {f: staging.size(spark, f) for f in files}
    rows_of = [footer_table(spark, f).count() for f in some]
    rate = sum(rows_of) / sum(bytes_of[f] for f in some)
    # error of the ratio estimator; files that are in the sample have none
    spread = sum((n - rate * bytes_of[f]) ** 2 for f, n in zip(some, rows_of)) / max(1, len(some) - 1)
    error = len(files) * ((1 - len(some) / len(files)) * spread / len(some)) ** 0.5
    return spark.createDataFrame([(round(rate * sum(bytes_of.values())), error)], schema)


def key_range(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key as text, ``"0"`` for an empty table."""
    return df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select(
        F.coalesce(F.col("lo").cast("string"), F.lit("0")).alias("min_key"),
        F.coalesce(F.col("hi").cast("string"), F.lit("0")).alias("max_key"),
    )
