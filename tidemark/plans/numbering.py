"""Dense numbers over a whole table without a single-task window.

Rows are range-partitioned on the order columns, numbered inside their
partition, written to the shared folder, and shifted by the number of rows in
earlier partitions. The written table fixes the partition borders: a second
range shuffle would sample again and could cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import sizes, staging

PARTITION_BYTES = 256 * 1024 * 1024
#: Inputs planned no larger than this, and of so few rows, are numbered by one task.
ONE_TASK_BYTES, ONE_TASK_ROWS = 16 * 1024 * 1024, 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def range_partitions(df: DataFrame) -> int:
    """Partitions for a full sort: the session's setting, more for big inputs."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sizes.planned_bytes(df) or 0
    return max(configured, min(200_000, size // PARTITION_BYTES))


def _one_task(df: DataFrame, narrow: DataFrame) -> bool:
    return sizes.fits(df, ONE_TASK_BYTES) and sizes.few_rows(narrow, ONE_TASK_ROWS)


def _offsets(df: DataFrame, totals: DataFrame, extra: str | None = None) -> DataFrame:
    """Rows in earlier partitions; one row per partition, so bounded."""
    rows = sorted(totals.collect(), key=lambda r: r["_pid"])
    out, before, last = [], 0, None
    for r in rows:
        out.append((r["_pid"], before, last) if extra else (r["_pid"], before))
        before += r["_n"]
        last = r[extra] if extra else None
    fields = [T.StructField("_pid", T.LongType()), T.StructField("_before", T.LongType())]
    if extra:
        fields.append(T.StructField("_last", totals.schema[extra].dataType))
    return F.broadcast(df.sparkSession.createDataFrame(out, T.StructType(fields)))


def with_row_number(
    df: DataFrame, order: list[str | Column], name: str, start: int = 1, one_task: bool | None = None
) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given order.

    ``one_task`` overrides the size check that lets a small input be numbered
    by a plain window.
    """
    if _one_task(df, df.select(*order)) if one_task is None else one_task:
        number = F.row_number().over(W.orderBy(*order)).cast("bigint") + F.lit(start - 1)
        return df.withColumn(name, number)
    ordered = df.repartitionByRange(range_partitions(df), *order).sortWithinPartitions(*order)
    fixed = staging.stage(
        ordered.withColumn("_m", F.monotonically_increasing_id()), "numbered"
    )
    pid = F.shiftright("_m", _ROW_BITS)
    totals = fixed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(df, totals)
    local = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        fixed.withColumn("_pid", pid)
        .join(offsets, "_pid")
        .withColumn(name, F.col("_before") + local + F.lit(start))
        .drop("_pid", "_before", "_m")
    )


def cumulative_by_key(df: DataFrame, key: str, weight: str, one_task: bool | None = None) -> DataFrame:
    """Per distinct key: weight before it and the key in front of it.

    ``df`` holds one row per ``key``. Returns ``key``, ``weight``, ``before``
    and ``prev``. Each range partition is one window group, so groups are as
    even as the range split.
    """
    kept = df.select(key, F.col(weight).cast("bigint").alias(weight))
    if _one_task(kept, kept.select(key)) if one_task is None else one_task:
        w = W.orderBy(key)
        before = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, -1))
        return kept.select(
            key, weight, F.coalesce(before, F.lit(0)).alias("before"), F.lag(key).over(w).alias("prev")
        )
    ordered = kept.repartitionByRange(range_partitions(kept), key)
    fixed = staging.stage(
        ordered.withColumn("_pid", F.spark_partition_id().cast("bigint")), "cumulative"
    )
    totals = fixed.groupBy("_pid").agg(F.sum(weight).alias("_n"), F.max(key).alias("_max"))
    offsets = _offsets(df, totals, "_max")
    w = W.partitionBy("_pid").orderBy(key)
    cum = F.coalesce(F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = fixed.select(key, weight, "_pid", cum.alias("_cum"), F.lag(key).over(w).alias("_prev"))
    return local.join(offsets, "_pid").select(
        key,
        weight,
        (F.col("_before") + F.col("_cum")).alias("before"),
        F.coalesce("_prev", "_last").alias("prev"),
    )
