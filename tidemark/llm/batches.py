"""Shared plumbing: session settings, Arrow batches, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans import sizes, staging
from ..session import prepare

#: Rows in one Arrow batch. Texts may be long, so a batch stays small.
BATCH_ROWS = 256
#: Bloom filters of shuffled joins; the filter itself is of bounded size.
BLOOM_CONF = {"enabled": "true", "creationSideThreshold": "4g", "applicationSideScanSizeThreshold": "64m"}
#: A staged table of at most this many bytes on disk may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches small enough for long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # join a few documents with all texts: drop most texts before the shuffle
    for key, value in BLOOM_CONF.items():
        spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{key}", value)
    return spark


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other Arrow batches for the jobs that run meanwhile, for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    return staging.stage(df, f"llm-{label}")


def drop(staged: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        staging.drop_path(staged.sparkSession, path)


def broadcast_if_small(staged: DataFrame) -> DataFrame:
    """Mark a staged table for broadcast if its files are proven small.

    Beyond the bound the join is left to shuffle. Parquet may be smaller on
    disk than in memory; the bound leaves room for that.
    """
    from pyspark.sql import functions as F

    return F.broadcast(staged) if sizes.fits(staged, BROADCAST_BYTES) else staged


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, schema, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` over single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, text_col: str, schema: str, function: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """``df`` with columns computed from the UTF-8 bytes of a text column.

    ``schema`` names the new columns; columns of ``df`` with those names are
    replaced. Null texts arrive as empty bytes.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    kept = df.drop(*new.names) if text_col not in new.names else df.drop(*(n for n in new.names if n != text_col))
    at = kept.columns.index(text_col)
    out = [c for c in kept.columns if c not in new.names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = function(texts(batch.column(at)))
        kept_columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in out]
        return pa.RecordBatch.from_arrays(kept_columns + made, out + new.names)

    return map_arrow(kept, StructType([kept.schema[c] for c in out] + new.fields), run)
