"""Key ranges, chunks and the bulk copy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..plans import numbering, sizes, skew
from .alter import ColumnPairs
from .inspect import Key, key_columns

#: Chunk lists up to this length are looked up in memory by each task.
MAX_LOOKUP_CHUNKS = 200_000
#: Whole numbers beyond this are not exact as doubles.
_EXACT_DOUBLE = 2**53


def scan_key_range(df: DataFrame, key: str, lo=None, hi=None, limit: int | None = None) -> DataFrame:
    """Rows with ``lo < key <= hi`` in key order; no range unless both ends are given.

    With a limit only the first rows of the range are returned.
    """
    if lo is not None and hi is not None:
        df = df.where((F.col(key) > lo) & (F.col(key) <= hi))
    rows = df.orderBy(key)
    return rows if limit is None else rows.limit(limit)


def next_key(df: DataFrame, key: str, last) -> DataFrame:
    """Smallest key above ``last``; no row at the end."""
    return df.where(F.col(key) > last).select(F.col(key).alias("next_key")).orderBy("next_key").limit(1)


def _key_value(keys: Sequence[str]) -> Column:
    """A key as one value that compares like its columns in order."""
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)


def _whole(keys: Sequence[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in keys])


def chunk_boundaries(df: DataFrame, key: Key, n: int, one_task: bool | None = None) -> DataFrame:
    """Split the table into chunks of about ``n`` rows in key order.

    A chunk holds the keys ``lo < key <= hi``, the first one also ``lo``; for a
    key of several columns both are structs. All rows of one key stay in one
    chunk, so a chunk is larger than ``n`` only where a single key is.
    ``chunk_id`` rises but may skip numbers after such a key. Keys are counted
    before the sort, so a hot key is one row of it. Rows without a whole key are
    in no chunk.
    """
    keys = key_columns(key)
    per_key = df.where(_whole(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbering.cumulative_by_key(per_key.select(_key_value(keys).alias("_key"), "_n"), "_key", "_n", one_task)
    return (
        placed.groupBy(F.floor(F.col("before") / n).cast("bigint").alias("chunk_id"))
        .agg(
            F.min("prev").alias("_prev"),
            F.min("_key").alias("_first"),
            F.max("_key").alias("hi"),
            F.sum("_n").alias("rows"),
        )
        .select("chunk_id", F.coalesce("_prev", "_first").alias("lo"), "hi", "rows")
    )


def project_pairs(df: DataFrame, pairs: ColumnPairs | Sequence[tuple[str, str]]) -> DataFrame:
    shared = pairs.shared if isinstance(pairs, ColumnPairs) else pairs
    return df.select(*[F.col(a).alias(b) for a, b in shared])


def copy_chunk(df: DataFrame, pairs, key: str, lo, hi) -> DataFrame:
    """Shared columns of all rows with ``lo < key <= hi``, in key order."""
    rows = df.where((F.col(key) > lo) & (F.col(key) <= hi)).orderBy(key)
    return project_pairs(rows, pairs)


def _bucketed(df: DataFrame, value: Column, starts: list, name: str) -> DataFrame:
    """Index of the interval ``[starts[i], starts[i+1])`` that holds ``value``.

    Values in front of the first start get -1. The binary search runs in the
    JVM over a sorted array that every task gets.
    """
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *map(float, starts), float("inf")]
    tagged = df.withColumn("_v", value.cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep")
    placed = bucketizer.transform(tagged)
    return placed.withColumn(name, (F.col("_b") - 1).cast("bigint")).drop("_v", "_b")


def assign_chunks(
    df: DataFrame, boundaries: DataFrame, key: Key, max_lookup: int = MAX_LOOKUP_CHUNKS,
    max_group_rows: int = skew.MAX_GROUP_ROWS,
) -> DataFrame:
    """Give each row the chunk that holds its key, NULL if none does.

    The key may be of any type that sorts, or several columns. A chunk list of
    checked size over whole numbers that doubles hold exactly is looked up by
    every task without any shuffle. Any other one is merged with the distinct
    keys in range partitions, where each key takes the last border before it.
    Rows get the chunk of their key by an equality join, which adaptive
    execution splits where a key is hot.
    """
    keys = key_columns(key)
    chunks = boundaries.select("chunk_id", "lo", "hi")
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType):
        rows = sizes.bounded_rows(chunks, max_lookup)
        if rows is not None and all(abs(r["lo"]) < _EXACT_DOUBLE and abs(r["hi"]) < _EXACT_DOUBLE for r in rows):
            return _assign_by_lookup(df, rows, keys[0])
    return _assign_by_merge(df, chunks, keys, max_group_rows)


def _assign_by_lookup(df: DataFrame, rows: list, key: str) -> DataFrame:
    rows = sorted(rows, key=lambda r: r["hi"])
    if not rows:
        return df.withColumn("chunk_id", F.lit(None).cast("bigint"))
    # (lo, hi] over whole numbers is [lo+1, hi+1); chunk 0 of the table starts at lo.
    starts = [r["lo"] + (r["chunk_id"] != 0) for r in rows]
    ids = df.sparkSession.createDataFrame(
        [(i, r["chunk_id"], r["hi"]) for i, r in enumerate(rows)],
        "_i bigint, chunk_id bigint, _hi bigint",
    )
    placed = _bucketed(df, F.col(key), starts, "_i").join(F.broadcast(ids), "_i", "left")
    inside = F.when(F.col(key) <= F.col("_hi"), F.col("chunk_id"))
    return placed.withColumn("chunk_id", inside).drop("_i", "_hi")


def _assign_by_merge(df: DataFrame, chunks: DataFrame, keys: Sequence[str], max_group_rows: int) -> DataFrame:
    kind = chunks.schema["lo"].dataType
    border = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("hi", kind)])
    present = df.where(_whole(keys)).select(*keys).distinct()
    sought = present.select(
        *keys, _key_value(keys).cast(kind).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(border).alias("_border")
    )
    # the first chunk's border stands before an equal key, the others after it
    borders = chunks.select(
        *[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], F.col("lo").alias("_at"),
        F.when(F.col("chunk_id") == 0, 0).otherwise(2).alias("_side"),
        F.struct(F.col("chunk_id").cast("bigint").alias("chunk"), "hi").cast(border).alias("_border"),
    )
    merged = skew.segment(sought.union(borders), [], ["_at", "_side"], max_group_rows)
    found = skew.last_before(merged, F.col("_border"), "_last").done()
    placed = found.where((F.col("_side") == 1) & (F.col("_at") <= F.col("_last.hi"))).select(
        *keys, F.col("_last.chunk").alias("chunk_id")
    )
    return df.join(placed, list(keys), "left").select(*df.columns, "chunk_id")


def row_copy(df: DataFrame, pairs, path: str, sort_key: str | None = None) -> DataFrame:
    """The whole back-fill: one projection, one write, all splits at once.

    With ``sort_key`` each file is key-ordered, so later key ranges skip row
    groups.
    """
    rows = project_pairs(df, pairs)
    if sort_key:
        rows = rows.sortWithinPartitions(sort_key)
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _missing(src: DataFrame, shadow: DataFrame, key: Key) -> DataFrame:
    held = shadow.select(*[F.col(k).alias(f"_held_{k}") for k in key_columns(key)])
    same = [src[k].eqNullSafe(held[f"_held_{k}"]) for k in key_columns(key)]
    return src.join(held, reduce(lambda p, q: p & q, same), "left_anti")


def copy_missing(src: DataFrame, shadow: DataFrame, key: Key) -> DataFrame:
    """The shadow plus the source rows it does not hold; safe to repeat."""
    return shadow.unionByName(_missing(src, shadow, key))


def remaining_rows(src: DataFrame, shadow: DataFrame, key: Key) -> DataFrame:
    """Number and share of keys not yet copied."""
    zero = F.lit(0).cast("bigint")
    left = _missing(src.select(*key_columns(key)), shadow, key).agg(F.count(F.lit(1)).alias("r")).select("r", zero.alias("t"))
    total = src.agg(F.count(F.lit(1)).alias("t")).select(zero.alias("r"), "t")
    return (
        left.union(total)
        .agg(F.sum("r").alias("remaining"), F.sum("t").alias("total"))
        .withColumn(
            "share",
            F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("remaining").cast("double") / F.col("total")),
        )
    )


def copy_progress(
    chunk_log: DataFrame, job: str, order: Sequence[str], ts: str, rows: str,
    max_group_rows: int = skew.MAX_GROUP_ROWS,
) -> DataFrame:
    """Per finished chunk of a job: rows so far, remaining, percent, elapsed, rate, ETA.

    The total of a job is the sum of its chunks; percent is 0 for an empty
    job, rate and ETA are 0 while nothing is done or no time has passed.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = chunk_log.withColumn("_us", us)
    totals = base.groupBy(F.col(job).alias("_job")).agg(
        F.sum(rows).alias("total_rows"), F.min("_us").alias("_start")
    )
    seg = skew.segment(base, [job], list(order), max_group_rows)
    seg = skew.running_sum(seg, F.col(rows), "copied_rows")
    df = seg.done().join(totals, F.col(job).eqNullSafe(F.col("_job"))).drop("_job")
    copied, total = F.col("copied_rows").cast("double"), F.col("total_rows").cast("double")
    elapsed = (F.col("_us") - F.col("_start")) / F.lit(1000000.0)
    df = df.withColumn("elapsed_s", elapsed)
    started = (F.col("elapsed_s") > 0) & (F.col("copied_rows") > 0)
    df = df.withColumn("rate", F.when(started, copied / F.col("elapsed_s")).otherwise(F.lit(0.0)))
    return df.select(
        *chunk_log.columns,
        "copied_rows",
        "total_rows",
        (F.col("total_rows") - F.col("copied_rows")).alias("remaining_rows"),
        F.when(F.col("total_rows") == 0, F.lit(0.0)).otherwise(copied / total * 100).alias("percent"),
        "elapsed_s",
        "rate",
        F.when(started, (F.col("total_rows") - F.col("copied_rows")) / F.col("rate"))
        .otherwise(F.lit(0.0))
        .alias("eta_s"),
    )
