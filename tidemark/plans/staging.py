"""Tables written to the shared folder so that later steps read fixed data."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of
    its own; on a cluster a machine-local folder would not be seen by the
    executors, so that is an error.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its staged tables."""
    return f"{staging_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete everything this application staged; results read from it end here."""
    drop_path(spark, application_folder(spark))


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    return stage_at(df, new_path(df.sparkSession, label), partition_by)


def stage_at(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """As ``stage``, to a folder the caller may drop later."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path, none if it does not exist."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    return [str(f.getPath()) for f in files.listStatus(target) if f.isDirectory()]


def files(spark: SparkSession, path: str, suffix: str) -> int:
    """How many files right below a path end in ``suffix``."""
    found, target = _file_system(spark, path)
    return sum(f.isFile() and f.getPath().getName().endswith(suffix) for f in found.listStatus(target))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    files, target = _file_system(spark, path)
    return files.getContentSummary(target).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the Hadoop file system it lives on."""
    files, target = _file_system(spark, path)
    files.delete(target, True)
