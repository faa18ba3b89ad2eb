"""Parquet tables of one data folder, and footer-answered aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose count, min and max come from the file footers.

    Aggregate push-down exists only in the version 2 reader, which is picked
    while the path is resolved.
    """
    prepare(spark)
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
