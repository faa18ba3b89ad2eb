"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that affect results or plans. Sizes (shuffle partitions, split
# bytes, broadcast threshold) stay with whoever owns the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Codec of Parquet results of which each row is many times its input row.
WIDE_CODEC = "zstd"


def wide_results(spark: SparkSession) -> SparkSession:
    """Parquet results are written in WIDE_CODEC from now on, unless the session's owner has named a codec."""
    key = "spark.sql.parquet.compression.codec"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, WIDE_CODEC)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a running session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
