"""Shards of a table in random order, by a shuffle in two passes.

The first pass scatters the records uniformly into buckets that fit in memory,
by a seeded hash of the place where a record is stored. The second one puts
each bucket in a fixed order, shuffles it by Fisher-Yates and writes it to the
shards that its stretch of the whole order belongs to. Every step depends on the
stored table and the seed alone, so a task that runs again writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans import staging
from . import batches

SHARDS, SEED = 40, 20_11
#: What a bucket should hold, by the sizes of its records, and what a record has besides its text.
BUCKET_BYTES, RECORD_BYTES = 16 << 20, 16
#: Their counts are on the driver and in each task: 8 MB at most. Beyond it buckets grow.
MOST_BUCKETS = 1 << 20
#: Beyond it a task takes several buckets, one after the other.
MOST_TASKS = 20_000


def size_of(text_col: str = "text"):
    """UTF-8 bytes of the text, none if it is null, and RECORD_BYTES."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order of a bucket's ``n`` records."""
    order = list(range(n))
    draws = np.random.Generator(np.random.Philox(key=[seed, bucket])).integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _by_bucket(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each bucket's records; rows come sorted by bucket, the first column."""
    now, held = None, []
    for batch in source:
        numbers = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                if held and numbers[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(numbers[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def shuffle(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", stored: bool = False,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, written to one folder per shard.

    All orders of the rows are alike likely over the seeds. Shards are equal
    stretches of the order, so that their row counts differ by one at most;
    slots are places in a shard, from 0 without a gap, and files hold rows in
    slot order. ``stored`` says that ``docs`` reads files that won't change;
    else it is written first. ``bucket_bytes`` bounds what is in memory at once
    but for a single record that is longer, or a table of over MOST_BUCKETS buckets.

    A row's values don't matter: null, equal and repeated rows are dealt like any
    others, so no group of them meets in one bucket. Texts may be of any length;
    null counts as empty. An empty table gives an empty one. Columns named
    ``shard`` or ``slot`` are replaced.
    """
    docs = docs if stored else batches.stage(docs, "shards-in")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    total, size = docs.select(size_of(text_col).alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-size // bucket_bytes)))
    tasks = min(buckets, MOST_TASKS)
    bucket = F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(buckets)).cast("int").alias("bucket")
    counts = np.zeros(buckets, dtype=np.int64)
    for number, n in docs.select(bucket).groupBy("bucket").count().toLocalIterator():
        counts[number] = n
    firsts = docs.sparkSession.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)]))

    schema = StructType([StructField("shard", IntegerType()), StructField("slot", LongType()), StructField("record", StructType([docs.schema[c] for c in kept]))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, records in _by_bucket(source):
            n, first = records.num_rows, int(firsts.value[number])
            if n != firsts.value[number + 1] - first:
                raise RuntimeError("the stored table changed meanwhile")
            position = first + np.arange(n)
            shard = position * shards // total
            slot = position - -(-shard * total // shards)
            shuffled = records.column(1).combine_chunks().take(pa.array(fisher_yates(n, seed, number)))
            for at in range(0, n, batches.BATCH_ROWS):
                part = slice(at, at + batches.BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[part], pa.int32()), pa.array(slot[part], pa.int64()), shuffled.slice(at, batches.BATCH_ROWS)],
                    ["shard", "slot", "record"])

    scattered = docs.select(bucket, F.struct(*kept).alias("record"), place[0].alias("file"), place[1].alias("row"))
    scattered = scattered.repartitionById(tasks, F.expr(f"CAST(bucket * {tasks}L DIV {buckets} AS INT)"))
    scattered = scattered.sortWithinPartitions("bucket", "file", "row").select("bucket", "record")
    written = scattered.mapInArrow(run, schema).select("record.*", "shard", "slot").sortWithinPartitions("shard", "slot")
    return staging.stage(written, "llm-shards", partition_by=["shard"]).select(*kept, "shard", "slot")


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, checksum, shard and slot of every document, read from the shards' files."""
    shards = shuffle(batches.table(spark, folder, "documents"), stored=True)
    return shards.select(
        "doc_id", size_of().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
