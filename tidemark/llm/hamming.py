"""Connected groups of 64-bit fingerprints that differ in few bits.

Fingerprints meet in buckets by key. A bucket is searched in one task if it is
small; a larger one is cut into a few tiles and each pair of tiles is searched on
its own. The members of one that would take more tiles meet again under longer
keys, so that rows and links grow with the fingerprints and not with the bucket;
no task holds an unbounded bucket and no pair is left out. A search gives only
the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .components import components

#: Fingerprints that one task compares with one another at most; larger
#: buckets are tiled.
TILE = 2048
#: Tiles of a bucket; the members of larger buckets get longer keys.
MOST_TILES = 16
#: Equal blocks in the longer keys, in turn. With a radius of 2 they hold 38 and
#: 48 of 64 bits, so the last buckets have 65,536 members at most.
EQUAL_BLOCKS = (3, 6)
#: Fingerprints of a run that is not searched on its own but with all short runs of a batch.
FEW = 24
_LANES = np.uint64(0x0101010101010101)
#: (rows with a column fp) -> the same rows with a column key, once for each key
Keyed = Callable[[DataFrame], DataFrame]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes of each run have; no run is empty."""
    # pieces of at most 255 hashes, whose votes fit in the bytes of a number
    pieces = (lengths + 254) // 255
    first_piece = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first_piece, pieces)
    starts = np.repeat(np.cumsum(lengths) - lengths, pieces) + 255 * within
    fps = np.zeros(len(lengths), dtype=np.uint64)
    if not len(lengths):
        return fps
    for bit in range(8):
        # every eighth bit, each summed in a byte of its own
        summed = np.add.reduceat(hashes >> np.uint64(bit) & _LANES, starts)
        votes = np.add.reduceat(summed.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        most = (votes * 2 > lengths[:, None]).astype(np.uint8)
        fps |= most.view(np.uint64).ravel() << np.uint64(bit)
    return fps


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within ``radius`` bits."""
    left, right = [], []
    if len(fps) <= FEW:  # plain numbers are faster than short arrays
        rest = fps.tolist()
        while rest:
            queue = [rest.pop()]
            while queue and rest:
                at = queue.pop()
                near = [x for x in rest if (x ^ at).bit_count() <= radius]
                if near:
                    left += [at] * len(near)
                    right += near
                    queue += near
                    rest = [x for x in rest if (x ^ at).bit_count() > radius]
        return np.array(left, dtype=np.uint64), np.array(right, dtype=np.uint64)
    waiting = np.arange(len(fps))
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            near = np.bitwise_count(fps[waiting] ^ fps[at]) <= radius
            if near.any():
                found = waiting[near]
                left.append(np.repeat(fps[at], len(found)))
                right.append(fps[found])
                queue.extend(found)
                waiting = waiting[~near]
    none = fps[:0]
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links_in_runs(fps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints within ``radius`` bits of each short run, for all runs at once.

    Rows are compared with the next one, the second next and so on. A link is
    left out if the next row is near both of its ends: these are linked already.
    """
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    fps = fps[np.repeat(starts, lengths) + within]
    behind = np.repeat(lengths, lengths) - within - 1  # rows of the run behind each one
    left, right = [fps[:0]], [fps[:0]]
    adjacent = before = None
    for step in range(1, int(lengths.max(initial=0))):
        at = np.flatnonzero(behind >= step)
        near = np.zeros(len(fps) + 1, dtype=bool)
        near[at] = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        if step == 1:
            adjacent = kept = near[:-1]
        else:
            kept = near[:-1] & ~(adjacent & before[1:])
        before = near
        at = np.flatnonzero(kept)
        left.append(fps[at])
        right.append(fps[at + step])
    return np.concatenate(left), np.concatenate(right)


def _unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def search_runs(
    search: Callable[[list[pa.RecordBatch]], object],
    emit: Callable[[list], pa.RecordBatch],
    spill: Callable[[list[pa.RecordBatch]], pa.RecordBatch] | None,
    few: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], object] | None = None,
):
    """Search runs of equal keys (first column) in sorted rows.

    ``search`` gets the rows of each run of two or more and finds something or
    None; ``emit`` makes a batch of what was found. With ``spill``, rows of a
    run longer than TILE go through it instead, as they come, so that a task
    never holds more of a run. ``few`` may take all runs of two to FEW rows of a
    batch at once, by their first rows and lengths.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the run that may go on in the next batch
        held_key, size, hot = None, 0, False
        for batch in source:
            if not batch.num_rows:
                continue
            found, spilled = [], []
            keys = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(keys)))
            # runs of one row that end within the batch need no search
            inner = np.ones(len(starts), dtype=bool)
            inner[[0, -1]] = False
            worth = ~inner | (lengths > 1)
            if few:
                short = inner & (lengths > 1) & (lengths <= min(FEW, TILE))
                worth &= ~short
                if short.any():
                    found.append(few(batch, starts[short], lengths[short]))
            for n in np.flatnonzero(worth).tolist():
                s, length = int(starts[n]), int(lengths[n])
                if keys[s] != held_key:
                    if size > 1 and not hot:
                        found.append(search(held))
                    held_key, held, size, hot = keys[s], [], 0, False
                size += length
                held.append(batch.slice(s, length))
                if spill and size > TILE:
                    hot = True
                if hot:
                    spilled.append(spill(held))
                    held = []
            found = [x for x in found if x is not None]
            if found:
                yield emit(found)
            yield from spilled
        if size > 1 and not hot and (last := search(held)) is not None:
            yield emit([last])

    return run


def tiled(members: DataFrame, order: str, label: str) -> DataFrame:
    """``members`` of oversized buckets under new keys: one for each pair of tiles of a bucket.

    Every two members of a bucket meet under some new key, and none of these
    has many more than 2 * TILE rows.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") * 2 / TILE).cast("int").alias("tiles"))
    sizes = batches.stage(sizes, f"{label}-tiles")
    both = members.join(batches.broadcast_if_small(sizes), "key")
    both = both.withColumn("own", F.pmod(F.xxhash64(order), "tiles"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return both.withColumn("key", key).select(members.columns)


def block_keys(fps: DataFrame, radius: int, equal: int) -> DataFrame:
    """(key, fp): fingerprints by each choice of ``equal`` out of ``radius + equal`` blocks of bits.

    Two fingerprints within the radius differ in ``radius`` blocks at most, so
    that some choice is equal in both.
    """
    blocks = radius + equal
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(masks, equal)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame, keyed: Keyed, radius: int, label: str) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` bits that share a key.

    ``fps`` has one column ``fp``, distinct and not null. The keys must give
    every pair within the radius a common one.
    """
    names = ["key", "a", "b"]

    def search(rows: list[pa.RecordBatch]):
        return spanning_links(np.unique(np.concatenate([_unsigned(r.column(1)) for r in rows])), radius)

    def emit(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate(part) for part in zip(*found))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), _signed(a), _signed(b)], names)

    def spill(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([r.column(i) for r in rows]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([columns[0], columns[1], columns[1]], names)

    def few(batch: pa.RecordBatch, starts: np.ndarray, lengths: np.ndarray):
        a, b = links_in_runs(_unsigned(batch.column(1)), starts, lengths, radius)
        return a[a != b], b[a != b]

    schema = "key long, a long, b long"  # a link if key is null, else a member of an oversized bucket
    with batches.rows_at_once(fps.sparkSession, 8192):  # rows of two numbers
        rows = keyed(fps.select("fp")).select("key", "fp")
        parts = []
        for equal in (*EQUAL_BLOCKS, None):
            found = batches.stage(
                rows.repartition("key").sortWithinPartitions("key").mapInArrow(search_runs(search, emit, spill, few), schema), f"{label}-links")
            parts.append(found.where(F.col("key").isNull()))
            hot = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"))
            huge = hot.groupBy("key").count().where(F.col("count") > MOST_TILES * TILE // 2).select("key")
            huge = None if equal is None else batches.stage(huge, f"{label}-huge")
            last = huge is None or huge.isEmpty()
            fitting = hot if last else hot.join(batches.broadcast_if_small(huge), "key", "left_anti")
            fitting = tiled(fitting, "fp", label).repartition("key").sortWithinPartitions("key")
            parts.append(fitting.mapInArrow(search_runs(search, emit, None, few), schema))
            if last:
                break
            again = hot.join(batches.broadcast_if_small(huge), "key", "left_semi").select("fp").distinct()
            rows = block_keys(again, radius, equal)
        both = reduce(DataFrame.union, [part.select("a", "b") for part in parts])
        return batches.stage(both.distinct(), f"{label}-edges")


def groups(fps: DataFrame, keyed: Keyed, radius: int, label: str) -> DataFrame:
    """(fp, group) for every fingerprint: the smallest fingerprint of its connected group."""
    joined = linked(fps, keyed, radius, label)
    return fps.select("fp").join(joined, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"))


def linked(fps: DataFrame, keyed: Keyed, radius: int, label: str) -> DataFrame:
    """(fp, group) as ``groups`` gives, without the fingerprints that are a group of their own."""
    joined = components(links(fps, keyed, radius, label), label)
    return joined.select(F.col("node").alias("fp"), F.col("component").alias("group"))
