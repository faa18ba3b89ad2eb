"""Run a stream over a folder of files until all of them are processed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans import staging

#: Time of the row that closes a finite input; later than any other.
END = datetime(9999, 1, 1, tzinfo=timezone.utc)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None,
    most_batches: int | None = None,
) -> DataFrame:
    """Stream the Parquet files of a folder, oldest first.

    A batch goes over the state of all before, so batches that grow in number
    with the input cost its square. With ``most_batches`` a batch takes more than
    ``files_per_trigger`` of the files that are there, if they need more batches
    than that.
    """
    if files_per_trigger and most_batches:
        files_per_trigger = max(files_per_trigger, -(-staging.files(spark, path, ".parquet") // most_batches))
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def close_folder(spark: SparkSession, path: str, schema, ts: str) -> None:
    """Add a last file whose only row moves the watermark past all others.

    Windows, timers and held rows of a finite input all come out then. Streams
    leave that row out themselves; the folder takes no more rows after it.
    """
    types = dict(spark.createDataFrame([], schema).dtypes)
    spark.range(1).select(
        *(F.lit(END.replace(tzinfo=None) if c == ts else None).cast(t).alias(c) for c, t in types.items())
    ).write.mode("append").parquet(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there, in as many micro-batches as the source limits ask for.

    Progress is kept in the checkpoint, so a stopped run goes on where it was.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def for_each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    run_available(df.writeStream.outputMode(mode).foreachBatch(handle), checkpoint)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep keyed state on disk, as it grows with the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
