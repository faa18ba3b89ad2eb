"""Token counts of the documents in flat token files that have no index.

A token file is a row of ids with a separator after each document. It is read
in blocks of fixed length that know nothing of documents. Each block is searched
for separators on its own; running sums over the blocks then tell how many
tokens a block's first document has had before it.
"""

from __future__ import annotations

import base64
from functools import cache
from typing import BinaryIO, Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import batches

#: The end-of-document id that no text encodes to.
SEPARATOR = 50256
#: Tokens of a block, two bytes each.
BLOCK_TOKENS = 1 << 16
#: Blocks whose running sums one task makes at a time.
SEGMENT_BLOCKS = 1024
#: Consecutive blocks of a file that are read in one go.
RANGE_BLOCKS = 64
DTYPE = "<u2"
#: Stores whose files tasks can open and seek in by themselves.
SEEKABLE = ("file", "hdfs", "s3", "gs")


@cache
def _encoding(ranks: bytes):
    import tiktoken

    from .bpe import PATTERN

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding(
        "flat", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def read_ranks(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def pack(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of (doc_id, text) rows: (file, block, data, doc_ids), staged.

    Each partition makes one file. ``data`` is a block of ids; a block may start
    and end anywhere in a document. Rows with ``doc_ids`` instead list, in file
    order, the documents from number ``block`` on; the scan does not read them.
    A null or empty text is a document of no tokens. Null and repeated ids are
    listed as they are; other columns are not read. A table without rows gives
    no blocks. A text may span any number of blocks.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value).encode_ordinary
        file = TaskContext.get().partitionId()
        held = np.empty(0, dtype=DTYPE)
        blocks = documents = 0

        def rows(block: int, parts: list[np.ndarray], ids=None) -> pa.RecordBatch:
            n = len(parts) if ids is None else 1
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.int32()), pa.array(range(block, block + n), pa.int64()),
                pa.array([p.tobytes() for p in parts] if ids is None else [None], pa.binary()),
                pa.array([None] * n if ids is None else [ids.to_pylist()], pa.list_(pa.int64())),
            ], ["file", "block", "data", "doc_ids"])

        for batch in source:
            parts = [held]
            for text in batches.texts(batch.column(1)):
                parts.append(np.array([*encode(text.decode()), SEPARATOR], dtype=DTYPE))
            held = np.concatenate(parts)
            full = len(held) // block_tokens
            if full:
                yield rows(blocks, [held[i * block_tokens : (i + 1) * block_tokens] for i in range(full)])
            blocks, held = blocks + full, held[full * block_tokens :]
            if batch.num_rows:
                yield rows(documents, [], batch.column(0))
            documents += batch.num_rows
        if len(held):
            yield rows(blocks, [held])

    schema = "file int, block long, data binary, doc_ids array<long>"
    return batches.stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "token-files")


def _open(path: str):
    """A seekable file for a path as Spark names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_files(
    spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = DTYPE, opener: Callable[[str], BinaryIO] | None = None,
) -> DataFrame:
    """(file, block, data) of the flat files in a folder, of any length.

    Files are listed by Spark and cut to stretches of RANGE_BLOCKS blocks, whose
    tasks seek to them, so one task never holds more than a block and a file of
    any size is read by many tasks. Stores other than SEEKABLE need an ``opener``
    that gives a seekable file for a path; without one their files are read
    whole, which Spark refuses from 2 GB on. An empty file has no blocks; equal
    files are files of their own.
    """
    size = block_tokens * np.dtype(dtype).itemsize
    schema = "file string, block long, data binary"
    names = ["file", "block", "data"]

    def seek(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for file, first, end in zip(*(column.to_pylist() for column in batch.columns)):
            with (opener or _open)(file) as source:
                source.seek(first * size)
                for block in range(first, end):
                    data = source.read(size)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for block, at in enumerate(range(0, len(data), size)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([data[at : at + size]], pa.binary())], names)

    files = spark.read.format("binaryFile").load(path)
    seekable = F.lit(True) if opener else F.regexp_extract("path", "^([a-z0-9]+):", 1).isin(*SEEKABLE)
    total = files.where(seekable).agg(F.sum("length")).first()[0] or 0
    last = F.ceil(F.col("length") / size)
    ranges = files.where(seekable & (F.col("length") > 0)).select(
        F.col("path").alias("file"), last.alias("blocks"), F.explode(F.sequence(F.lit(0), last - 1, F.lit(RANGE_BLOCKS))).alias("first"),
    ).select("file", "first", F.least(F.col("first") + RANGE_BLOCKS, "blocks").alias("end"))
    ranges = ranges.repartition(max(1, -(-total // (4 * RANGE_BLOCKS * size))))
    return batches.map_arrow(ranges, schema, seek).union(
        batches.map_arrow(files.where(~seekable).select("path", "content"), schema, cut))


def search_blocks(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """One row per block: its tokens and separators, and the counts it can tell by itself.

    ``head`` is the number of tokens before the first separator, ``tail`` that
    after the last one (all tokens if there is none), ``inner`` the documents between.
    """
    kind = dict(blocks.dtypes)["file"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, separators, heads, tails, inner = [], [], [], [], []
        for data in batch.column(2).to_pylist():
            ids = np.frombuffer(data or b"", dtype=dtype)
            at = np.flatnonzero(ids == separator)
            tokens.append(len(ids))
            separators.append(len(at))
            heads.append(int(at[0]) if len(at) else 0)
            tails.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
            inner.append(np.diff(at) - 1)
        longs = [pa.array(x, pa.int64()) for x in (tokens, separators, heads, tails)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *longs, pa.array(inner, pa.list_(pa.int64()))],
            ["file", "block", "tokens", "separators", "head", "tail", "inner"])

    return batches.map_arrow(
        blocks.select("file", "block", "data"),
        f"file {kind}, block long, tokens long, separators long, head long, tail long, inner array<long>", run)


def count(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """(file, number, n_tokens, complete): the tokens of each document, separator not counted.

    Documents are numbered from 0 in each file. Blocks of a file are in order of
    ``block``; an empty or null block has no tokens. Two separators in a row
    enclose a document of no tokens. Tokens after a file's last separator are a
    document that is not complete. Running sums are made within segments of
    blocks, then over the segments, so that a huge file needs no single task.
    """
    found = batches.stage(search_blocks(blocks, separator, dtype).withColumn("segment", F.floor(F.col("block") / SEGMENT_BLOCKS)), "tokens-blocks")
    before = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumns({
        "start": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        "earlier": F.coalesce(F.sum("separators").over(before), F.lit(0)),
    }).withColumn("ended", F.when(F.col("separators") > 0, F.col("start") + F.col("tokens") - F.col("tail")))
    placed = placed.withColumn("last", F.max("ended").over(before))
    sums = placed.groupBy("file", "segment").agg(
        F.sum("tokens").alias("tokens"), F.sum("separators").alias("separators"), F.max("ended").alias("ended"))
    segments = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns({
        "file_start": F.coalesce(F.sum("tokens").over(segments), F.lit(0)),
        "file_earlier": F.coalesce(F.sum("separators").over(segments), F.lit(0)),
    }).withColumn("file_ended", F.col("file_start") + F.col("ended"))
    offsets = batches.stage(offsets.withColumn("file_last", F.max("file_ended").over(segments)), "tokens-segments")
    joined = placed.join(
        batches.broadcast_if_small(offsets.select("file", "segment", "file_start", "file_earlier", "file_last")), ["file", "segment"])
    last = F.greatest(F.col("file_start") + F.col("last"), F.col("file_last"), F.lit(0))
    first = F.col("head") + F.col("file_start") + F.col("start") - last
    documents = joined.where("separators > 0").select(
        "file", (F.col("file_earlier") + F.col("earlier")).alias("number"), F.posexplode(F.concat(F.array(first), "inner")).alias("i", "n_tokens"),
    ).select("file", (F.col("number") + F.col("i")).alias("number"), "n_tokens", F.lit(True).alias("complete"))
    ends = offsets.groupBy("file").agg(
        F.sum("separators").alias("number"), (F.sum("tokens") - F.coalesce(F.max("file_ended"), F.lit(0))).alias("n_tokens"))
    return documents.union(ends.where("n_tokens > 0").select("file", "number", "n_tokens", F.lit(False)))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, number in the file and n_tokens of every document.

    One row per row of ``documents``, also for null, empty and repeated texts and
    null or repeated ids, as rows are told apart by their place in the files.
    """
    files = pack(batches.table(spark, folder, "documents"))
    counts = count(files.where("data IS NOT NULL"))
    names = files.where("doc_ids IS NOT NULL").select("file", "block", F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("block") + F.col("i")).alias("number"), "doc_id")
    return names.join(counts, ["file", "number"], "left").select("doc_id", "file", "number", "n_tokens")
