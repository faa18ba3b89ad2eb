"""SimHash near-duplicates of documents, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two errors leave a pair of
segments of which one is equal and the other has at most one error; four such
pairs cover all cases (pigeonhole). The key of a pair is the equal segment and
one of the codeword indices near the other, so a fingerprint has up to 24 keys.
Fingerprints that share a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, golay, hamming, minhash

#: First bit and width of each segment; a width is at most 23.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (equal segment, segment with at most one error)
PAIRS = ((0, 1), (0, 2), (1, 2), (2, 0))
RADIUS = 2
SEED = 42
#: Least Jaccard similarity of near copies in ``keep_one``.
SIMILARITY = 0.8
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 1 << 14

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def shingles(text: bytes, width: int):
    """Lower-cased word shingles, repeats included; the whole sequence if shorter."""
    words = text.translate(_LOWER).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def _five_words(text: bytes):
    return shingles(text, 5)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, width)], dtype=np.uint64)
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[votes * 2 > len(hashes)].sum(dtype=np.uint64))


def hashes(grams: Iterable[bytes]) -> np.ndarray:
    """The hashes of shingles whose bits make a fingerprint."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in grams]), dtype=">u8").astype(np.uint64)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all fingerprints, with the row each belongs to."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, found = [], []
    for number, (equal, near) in enumerate(PAIRS):
        index, is_set = golay.keys(parts[near])
        key = (parts[equal][:, None] << 14) | (index << 2) | number
        rows.append(np.nonzero(is_set)[0])
        found.append(key[is_set])
    return np.concatenate(rows), np.concatenate(found)


def with_golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint once for each of its keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy()
        rows, keys = golay_keys(values.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], ["key", "fp"])

    return batches.map_arrow(fps.select("fp"), "key long, fp long", run)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; a null or empty text has fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = minhash.voted([hashes(shingles(t, width)) for t in batches.texts(batch.column(1))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return batches.map_arrow(docs.select(F.col(id_col), F.col(text_col)), f"id {kind}, fp long", run)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) per row: the smallest id reachable over links of at most ``radius`` bits.

    Texts without words (null, empty, white space) have fingerprint 0 and link
    like any other. Rows that repeat an id each give a row. A null id counts as
    no id when the smallest is picked; a component of null ids only is null.
    Extra columns are ignored. An empty table gives an empty result. Exact
    copies share one fingerprint and are never compared; ``radius`` is at most 2.
    """
    if radius > RADIUS:
        raise ValueError(f"the keys find pairs within {RADIUS} bits")
    rows = batches.stage(fingerprints(docs, width, id_col, text_col), "simhash")
    fps = batches.stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-fps")
    group = batches.stage(hamming.groups(fps, with_golay_keys, radius, "simhash"), "simhash-groups")
    named = group.join(fps, "fp")
    roots = batches.stage(named.groupBy("group").agg(F.min("first").alias("component")), "simhash-roots")
    labels = batches.stage(group.join(roots, "group").select("fp", "component"), "simhash-labels")
    return rows.join(labels, "fp").select("id", "fp", "component")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of each group of fingerprints within RADIUS bits."""
    nodes = batches.stage(nodes, "near-copies-fps")
    fps = batches.stage(nodes.groupBy("fp").agg(F.count("*").alias("n")), "near-copies-distinct")
    linked = batches.stage(hamming.linked(fps, with_golay_keys, RADIUS, "near-copies-simhash"), "near-copies-linked")
    # groups of two nodes or more: linked fingerprints, and those of several nodes
    group = fps.join(batches.broadcast_if_small(linked), "fp", "left").where((F.col("n") > 1) | F.col("group").isNotNull())
    group = batches.broadcast_if_small(batches.stage(group.select("fp", F.coalesce("group", "fp").alias("group")), "near-copies-groups"))
    named = batches.stage(nodes.join(group, "fp").select("group", F.col("node").alias("b")), "near-copies-named")
    heads = named.groupBy("group").agg(F.min("b").alias("a"), F.max("b").alias("_last")).where("a != _last").drop("_last")
    heads = batches.broadcast_if_small(batches.stage(heads, "near-copies-heads"))
    return named.join(heads, "group").where("a != b").select("a", "b")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the smallest ``doc_id`` stays.

    Near copies are texts whose SimHash fingerprints over five-word shingles, found
    by their Golay keys as in ``near_duplicates``, differ in at most RADIUS bits.
    These miss most copies with edits, so texts that share at least SIMILARITY of
    their sets of shingles are near copies as well, by exact comparison of
    candidates from MinHash bands. A group is connected over links of both kinds. A document without
    any word has no content to compare, so of those, too, one stays. Rows are
    told apart by id and text: of rows that repeat both one stays, and a row
    that only repeats an id is judged by its own text. Documents whose id is
    null are never removed.
    """
    gone, repeated = minhash.copies(docs, _five_words, SIMILARITY, hashes, _alike)
    gone = batches.stage(gone, "near-copies-gone")
    repeated = batches.stage(repeated, "near-copies-repeated")

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = batches.broadcast_if_small(some)
        return rows.join(some, (rows.doc_id == some.doc_id) & (F.xxhash64(rows.text) == some["copy"]), how).select(docs.columns)

    left = among(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left
    return among(left, repeated, "left_anti").union(among(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id for every document."""
    found = near_duplicates(batches.table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
