"""Connected groups of texts by exact Jaccard similarity of their shingle sets.

Texts of equal sets are one node. MinHash bands give candidates: nodes that
share a band are in one cluster, a few joins for any size of band. Within a
cluster, nodes that share a band are compared by their whole sets. A cluster
too large for a task is first held against its smallest node; what is not near
that one is compared with all in tiles, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import batches, hamming
from .components import components

#: Bands and minima of a band: of pairs with similarity 0.8, 1 - (1 - 0.8^5)^20
#: = 99.96 % share a band, of more similar ones more.
BANDS, ROWS = 20, 5
#: Nodes and shingles that one search takes at most.
TILE_NODES, TILE_GRAMS = 1024, 2_000_000
#: Shingles whose minima are taken at once.
GRAMS_AT_ONCE = 512

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1)

#: (text) -> its shingles
Grams = Callable[[bytes], Iterable[bytes]]


def gram_set(grams: Iterable[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of shingles."""
    found = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams)), dtype=">u8").astype(np.uint64)
    found.sort()
    return found[np.concatenate([found[:1] == found[:1], found[1:] != found[:-1]])]


def voted(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint that the hashes of each text vote for; 0 without any."""
    lengths = np.array([len(x) for x in hashes], dtype=np.int64)
    fps = np.zeros(len(hashes), dtype=np.uint64)
    if lengths.any():
        fps[lengths > 0] = hamming.majority_bits(np.concatenate(hashes), lengths[lengths > 0])
    return fps


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), GRAMS_AT_ONCE):
        np.minimum(least, (found[at : at + GRAMS_AT_ONCE] * _FACTORS + _TERMS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=n) for n, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spanning_sets(keys: np.ndarray, sets: list[np.ndarray], joined: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets that share a band and are similar; ``joined`` ones are linked already."""
    lengths = np.array([len(s) for s in sets])
    queue, waiting = np.flatnonzero(joined).tolist(), np.flatnonzero(~joined)
    found = []
    while len(waiting):
        if not queue:
            queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            to_try = (keys[waiting] == keys[at]).any(axis=1) & (
                np.minimum(lengths[waiting], lengths[at]) >= least * np.maximum(lengths[waiting], lengths[at]) - 1e-9)
            near = [int(i) for i in waiting[to_try] if jaccard(sets[at], sets[i]) >= least - 1e-9]
            if near:
                found += [(at, i) for i in near]
                queue += near
                waiting = waiting[~np.isin(waiting, near)]
    return found


def _copy() -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64("text")


def _node() -> Column:
    return F.struct("h1", "h2")


def signatures(docs: DataFrame, grams: Grams, hashes: Callable[[list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, copy, h1, h2, size, bands, fp) for every row: a 128-bit hash of the set, its size and band keys, and the
    fingerprint that the ``hashes`` of the shingles vote for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, votes = [], []
        for text in batches.texts(batch.column(2)):
            found = list(grams(text))
            sets.append(gram_set(found))
            votes.append(hashes(found) if hashes else np.empty(0, np.uint64))
        fps = voted(votes).view(np.int64)
        halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=">i8").astype(np.int64).reshape(-1, 2)
        keys = pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(s) for s in sets], pa.int64()), keys, pa.array(fps)],
            ["doc_id", "copy", "h1", "h2", "size", "bands", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return batches.map_arrow(
        docs.select("doc_id", _copy().alias("copy"), "text"),
        f"doc_id {kind}, copy long, h1 long, h2 long, size long, bands array<long>, fp long", run)


MEMBER = "key long, h1 long, h2 long, bands array<long>, joined boolean, grams binary"


def _with_sets(docs: DataFrame, members: DataFrame, grams: Grams) -> DataFrame:
    """``members`` (cluster, first, h1, h2, bands, tiles) as MEMBER rows, their sets made again from the first text."""
    # selective, so that Spark may test documents against a Bloom filter before it shuffles them
    small = batches.broadcast_if_small(members).where("tiles > 0")
    texts = docs.select("doc_id", _copy().alias("copy"), "text")
    joined = texts.join(
        small, texts.doc_id.eqNullSafe(F.col("first.doc_id")) & (texts["copy"] == F.col("first.copy"))
    ).select("key", "h1", "h2", "bands", F.lit(False).alias("joined"), "text", "tiles")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([gram_set(grams(t)).tobytes() for t in batches.texts(batch.column(5))], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], sets, batch.column(6)], [*batch.schema.names[:5], "grams", "tiles"])

    return batches.map_arrow(joined, f"{MEMBER}, tiles int", run)


def _search(members: DataFrame, least: float) -> DataFrame:
    """(a, b): links found among the members of each key."""

    def search(rows: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(rows).combine_chunks()
        keys = np.asarray(rows.column(3).combine_chunks().flatten()).reshape(-1, BANDS)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows.column(5).to_pylist()]
        found = spanning_sets(keys, sets, rows.column(4).to_numpy(), least)
        halves = [rows.column(i).to_numpy() for i in (1, 2)]
        return [np.array([half[pair[end]] for pair in found], dtype=np.int64) for end in (0, 1) for half in halves]

    def emit(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*found)], ["a1", "a2", "b1", "b2"])

    found = members.select("key", "h1", "h2", "bands", "joined", "grams").repartition("key").sortWithinPartitions("key").mapInArrow(
        hamming.search_runs(search, emit, None), "a1 long, a2 long, b1 long, b2 long")
    return found.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))


def _near_head(members: DataFrame, least: float) -> DataFrame:
    """``members`` with ``joined``: whether the set is similar to that of ``head``."""
    at, to, flag = (members.columns.index(c) for c in ("grams", "head", "joined"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads = batch.column(to).field("grams").to_pylist()
        near = [
            jaccard(*(np.frombuffer(x, dtype=np.uint64) for x in pair)) >= least - 1e-9
            for pair in zip(batch.column(at).to_pylist(), heads)]
        columns = list(batch.columns)
        columns[flag] = pa.array(near, pa.bool_())
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = StructType([StructField(f.name, BooleanType()) if f.name == "joined" else f for f in members.schema.fields])
    return batches.map_arrow(members, schema, run)


def _hot_links(hot: DataFrame, least: float) -> DataFrame:
    """(a, b) within clusters over a tile: links to the head, and between the rest and all."""
    heads = batches.stage(hot.groupBy("key").agg(F.min(F.struct("h1", "h2", "grams")).alias("head")), "sets-heads")
    with_head = hot.join(batches.broadcast_if_small(heads), "key").select(*hot.columns, "head")
    judged = batches.stage(_near_head(with_head, least).drop("head"), "sets-judged")
    first = heads.select("key", F.struct("head.h1", "head.h2").alias("a"))
    links = judged.where("joined").select("key", _node().alias("b")).join(batches.broadcast_if_small(first), "key").select("a", "b")
    rest = judged.where("not joined")
    if rest.isEmpty():
        return links
    size = F.length("grams") / 8
    tiles = F.ceil(F.greatest(F.count("*") / TILE_NODES, F.sum(size) / TILE_GRAMS)).cast("int")
    parts = batches.stage(rest.groupBy("key").agg(tiles.alias("parts")), "sets-parts")
    both = judged.join(batches.broadcast_if_small(parts), "key")
    own = lambda n: F.pmod(F.xxhash64("h1", "h2"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = F.xxhash64("key", "part", "tile")
    mine = both.where("not joined").withColumn("part", own("parts")).withColumn("tile", others("tiles"))
    # a node of the rest that meets itself in its own tile is there once
    theirs = both.withColumn("tile", own("tiles")).withColumn("part", others("parts")).where(F.col("joined") | (own("parts") != F.col("part")))
    met = mine.union(theirs.select(mine.columns)).withColumn("key", tile)
    return links.union(_search(met, least))


def near_links(docs: DataFrame, nodes: DataFrame, grams: Grams, least: float) -> DataFrame:
    """(a, b): links that connect the nodes that share a band and have a Jaccard similarity of ``least``."""
    keyed = batches.stage(nodes.select(F.explode("bands").alias("band"), _node().alias("b")), "sets-bands")
    firsts = batches.stage(keyed.groupBy("band").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a"), "sets-firsts")
    stars = keyed.join(batches.broadcast_if_small(firsts), "band").where("a != b").select("a", "b").distinct()
    clusters = components(stars, "sets-clusters")
    placed = nodes.join(
        batches.broadcast_if_small(batches.stage(clusters.select("node.*", F.xxhash64("component").alias("key")), "sets-placed")), ["h1", "h2"])
    placed = batches.stage(placed.select("key", "first", "h1", "h2", "bands", "size"), "sets-members")
    tiles = F.ceil(F.greatest(F.count("*") / TILE_NODES, F.sum("size") / TILE_GRAMS)).cast("int")
    sizes = batches.stage(placed.groupBy("key").agg(tiles.alias("tiles")), "sets-sizes")
    members = batches.stage(placed.join(batches.broadcast_if_small(sizes), "key"), "sets-tiles")
    small = _search(_with_sets(docs, members.where("tiles = 1"), grams), least)
    found = batches.stage(small, "sets-links")
    large = members.where("tiles > 1")
    if not large.isEmpty():
        hot = batches.stage(_with_sets(docs, large, grams).dropDuplicates(["key", "h1", "h2"]), "sets-hot")
        found = found.union(batches.stage(_hot_links(hot, least), "sets-hot-links"))
    # rows that repeat id and text give a node again, hence links from a node to itself
    return found.where("a != b")


def copies(
    docs: DataFrame, grams: Grams, least: float, hashes: Callable[[list[bytes]], np.ndarray] | None = None,
    alike: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables of (doc_id, copy): the rows that are copies of others, and the kept ones that are there more than once.

    Of each connected group of sets with a Jaccard similarity of ``least`` the
    row with the smallest (doc_id, copy) is no copy; ``copy`` is a hash of the
    text. Null ids are neither. ``alike`` gives more links, (a, b) of sets, from
    (fp, node): the fingerprints of the texts with words and their sets.
    """
    rows = batches.stage(signatures(docs, grams, hashes), "sets")
    place = F.struct("doc_id", "copy")
    nodes = batches.stage(
        rows.groupBy("h1", "h2").agg(
            F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(place).alias("first"),
            F.min(F.when(F.col("doc_id").isNotNull(), place)).alias("least"), F.count("*").alias("n")), "sets-nodes")
    links = near_links(docs, nodes, grams, least)
    if alike is not None:
        links = links.union(alike(rows.where("size > 0").select("fp", _node().alias("node")).distinct()))
    linked = components(links, "sets-groups")
    near = batches.stage(linked.select("node.*", F.col("component").alias("near")), "sets-near")
    grouped = nodes.join(batches.broadcast_if_small(near), ["h1", "h2"], "left").where("n > 1 OR near IS NOT NULL")
    grouped = batches.stage(grouped.select("h1", "h2", F.coalesce("near", _node()).alias("group"), "least"), "sets-grouped")
    kept = batches.stage(grouped.groupBy("group").agg(F.min("least").alias("kept")), "sets-kept")
    verdicts = batches.stage(grouped.join(kept, "group").select("h1", "h2", "kept"), "sets-verdicts")
    judged = batches.stage(
        rows.where("doc_id is not null").join(batches.broadcast_if_small(verdicts), ["h1", "h2"])
        .groupBy("doc_id", "copy").agg(F.first(place != F.col("kept")).alias("gone"), F.count("*").alias("n")), "sets-judged-rows")
    return judged.where("gone").select("doc_id", "copy"), judged.where("not gone and n > 1").select("doc_id", "copy")
