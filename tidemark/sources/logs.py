"""Change logs on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords

CHANGE_LOG_SCHEMA = (
    "file string, pos bigint, tx_id bigint, db string, tbl string, event_type string, "
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, price_cents bigint, "
    "st_before string, cents_before bigint, key_before bigint"
)


def write_change_log(log: DataFrame, path: str) -> None:
    """Store a log with one folder per log file number, ordered inside.

    Rows are dealt out by position, so one log file number may take many tasks.
    """
    (
        log.withColumn("seq", coords.file_sequence(F.col("file")))
        .repartitionByRange("seq", "pos")
        .sortWithinPartitions("seq", "pos")
        .write.mode("overwrite").partitionBy("seq").parquet(path)
    )


def read_change_log(
    spark: SparkSession, path: str, start: tuple[str, int], schema: str = CHANGE_LOG_SCHEMA
) -> DataFrame:
    """Change rows from a starting position on.

    The position must name a file and an offset above 0. Folders of earlier
    log files are not read.
    """
    file, pos = start
    if not file or pos <= 0:
        raise ValueError(f"not a log position: {start}")
    tail = file.rpartition(".")[2] if "." in file else ""
    seq = int(tail) if tail.isdigit() else 0
    log = spark.read.schema(f"{schema}, seq bigint").parquet(path)
    return log.where(coords.at_or_after(F.col("seq"), F.col("pos"), seq, pos))
