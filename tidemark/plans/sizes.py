"""Size checks that guard broadcasts and driver-side metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inputs whose planned size is below this cannot hold a harmful hot group.
SMALL_INPUT_BYTES = 64 * 1024 * 1024
#: Planned size below which a side may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Inputs planned no larger than this may be too few splits for all cores.
SPREAD_BYTES = 128 * 1024 * 1024
#: A table planned no larger than this is shuffled without a second thought.
CHEAP_SHUFFLE_BYTES = 512 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a DataFrame, None where it is not exposed."""
    if not hasattr(df, "_jdf"):  # no JVM plan at hand (Spark Connect)
        return None
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, limit: int) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= limit


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Deal a small input to all cores before costly column work.

    A small Parquet file is often one row group and thus one task. Larger
    inputs have splits enough and are left alone.
    """
    if not by or not fits(df, SPREAD_BYTES):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def few_rows(df: DataFrame, most: int) -> bool:
    """Whether there are at most ``most`` rows; a planned size can't tell, as files are compressed."""
    return df.limit(most + 1).count() <= most


def bounded_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows if there are at most ``max_rows`` of them, else None.

    Never brings more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame | None:
    """A broadcast copy of ``df`` if its row count is proven small, else None."""
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
