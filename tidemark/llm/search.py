"""Ranked lexical search of a set of queries over all documents.

A document's impacts, one per term, are hashed to coordinates and folded into
their maxima. A query's terms, looked up there, give an upper bound of its
score: a whole batch of documents and block of queries is one matrix product.
Documents are then scored exactly in descending order of their bounds, until a
bound falls below the score that a document must have to be among the best.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import batches

#: Results of a query.
TOP = 50
#: Coordinates of a sketch.
COORDINATES = 1 << 14
#: Queries, and terms of queries, that one pass over the documents looks for.
BLOCK_ITEMS, BLOCK_TERMS = 256, 200_000
#: Documents of one product of matrices, and bytes of their texts (or one longer text).
STEP_DOCS, STEP_BYTES = 512, 4 << 20
#: Terms whose coordinates a task keeps.
KNOWN_TERMS = 300_000

#: Maps what belongs to no term to a blank, and A-Z to a-z.
TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, all_terms: int) -> int:
    """A document's m: 50, and 50 times its length in terms by the mean length."""
    return 50 + 50 * n * n_docs // all_terms


def impact(tf, m):
    """What an occurrence count adds for each unit of weight; numbers or arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass
class Block:
    """Some queries: their numbers, and (term, weight) pairs, with the matrix that gives bounds."""

    numbers: list[int]
    terms: list[list[tuple[bytes, int]]]
    n_docs: int
    all_terms: int
    coordinates: int = COORDINATES
    step_docs: int = STEP_DOCS

    def coordinate(self, term: bytes) -> int:
        return crc32(term) % self.coordinates

    def __post_init__(self) -> None:
        at = sorted({self.coordinate(term) for pairs in self.terms for term, _ in pairs})
        #: Column of each coordinate that a query looks up, the number of columns for others.
        self.column = np.full(self.coordinates, len(at), dtype=np.int64)
        self.column[at] = np.arange(len(at))
        self.weights = np.zeros((len(at), len(self.numbers)))
        for i, pairs in enumerate(self.terms):
            for term, w in pairs:
                self.weights[self.column[self.coordinate(term)], i] += w


class Sketches:
    """Folds documents into maxima by coordinate."""

    def __init__(self, block: Block):
        self.block, self.known = block, {}

    def fold(self, docs: list[Counter], norms: list[int]) -> np.ndarray:
        """The coordinatewise maxima of the impacts of each document, in the block's columns."""
        known = self.known
        if len(known) > KNOWN_TERMS:
            known.clear()
        columns, width = self.block.column, self.block.weights.shape[0]
        for terms in docs:
            for term in terms:
                if term not in known:
                    known[term] = int(columns[self.block.coordinate(term)])
        sizes = [len(terms) for terms in docs]
        column = np.array([known[t] for terms in docs for t in terms], dtype=np.int64)
        tf = np.array([n for terms in docs for n in terms.values()], dtype=np.int64)
        wanted = np.flatnonzero(column < width)
        row, norm = (np.repeat(np.asarray(x, dtype=np.int64), sizes)[wanted] for x in (range(len(docs)), norms))
        out = np.zeros(len(docs) * width)
        np.maximum.at(out, row * width + column[wanted], impact(tf[wanted], norm).astype(float))
        return out.reshape(len(docs), width)

    def bounds(self, docs: list[Counter], norms: list[int]) -> np.ndarray:
        """An upper bound of the score of each document (row) for each query (column)."""
        # sums are exact below 2**53; the factor covers rounding beyond that
        return self.fold(docs, norms) @ self.block.weights * (1 + 1e-9)


def score(terms: Counter, m: int, query: list[tuple[bytes, int]]) -> int:
    return sum(w * impact(tf, m) for term, w in query if (tf := terms.get(term)))


def _steps(source: Iterator[pa.RecordBatch], step_docs: int) -> Iterator[list[tuple]]:
    """(doc_id, term counts, length) of some documents at a time, those without a term left out."""
    held, size = [], 0
    for batch in source:
        for doc_id, text in zip(batch.column(0).to_pylist(), batches.texts(batch.column(1))):
            terms = terms_of(text)
            if terms:
                held.append((doc_id, Counter(terms), len(terms)))
                size += len(text)
            if len(held) == step_docs or size >= STEP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def best_of(source: Iterator[pa.RecordBatch], block: Block, top: int = TOP) -> list[list[tuple[int, int, int | None]]]:
    """The best (score, order, doc_id) of each query over these documents; equal scores by doc_id, null ids last."""
    sketches = Sketches(block)
    best: list[list[tuple]] = [[] for _ in block.numbers]
    for docs in _steps(source, block.step_docs):
        ids, counts, lengths = zip(*docs)
        norms = [length_norm(n, block.n_docs, block.all_terms) for n in lengths]
        bounds = sketches.bounds(counts, norms)
        for query, held, above in zip(block.terms, best, bounds.T):
            least = held[0][0] if len(held) == top else 1
            likely = np.flatnonzero(above >= least)
            for i in likely[np.argsort(-above[likely], kind="stable")].tolist():
                if above[i] < least:
                    break
                found = score(counts[i], norms[i], query)
                if not found:
                    continue
                # of equal scores the least doc_id is the largest entry
                entry = (found, -ids[i] if ids[i] is not None else -math.inf, ids[i])
                if len(held) < top:
                    heapq.heappush(held, entry)
                elif entry[:2] > held[0][:2]:
                    heapq.heapreplace(held, entry)
                if len(held) == top:
                    least = held[0][0]
    return best


def _queries(items: DataFrame, text_col: str) -> DataFrame:
    """Staged (number, row, terms) of each item; ``terms`` once each, null text has none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [sorted(set(terms_of(t))) for t in batches.texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["number", "terms"])

    numbered = batches.stage(items.select(F.monotonically_increasing_id().alias("number"), F.col(text_col).alias("text"), F.struct(*items.columns).alias("row")), "search-items")
    terms = batches.map_arrow(numbered.select("number", "text"), "number long, terms array<binary>", run)
    return numbered.drop("text"), batches.stage(terms, "search-terms")


def _counted(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each term of a vocabulary."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, df = 0, 0, Counter()
        for batch in source:
            for text in batches.texts(batch.column(1)):
                terms = terms_of(text)
                n, size = n + bool(terms), size + len(terms)
                df.update(wanted.value.intersection(terms))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([size, *[0] * len(df)], pa.int64())],
            ["term", "n", "size"])

    sums = docs.mapInArrow(run, "term binary, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    totals = next(((r.n, r.size) for r in sums if r.term is None), (0, 0))
    return *totals, {bytes(r.term): r.n for r in sums if r.term is not None}


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", query_col: str = "text",
    coordinates: int = COORDINATES, step_docs: int = STEP_DOCS,
) -> DataFrame:
    """The ``top`` documents of each row of ``items``: (item, rank, doc_id, score).

    ``item`` is a struct of the row's columns. ``docs`` has doc_id and a text.
    Ranks are from 1, highest score first, equal scores by doc_id, null ids last;
    repeated rows are documents, or queries, of their own. Whole texts count;
    null and empty ones have no term. A query without a match, or an empty table
    on either side, gives no rows. Other columns of ``docs`` are not read.

    Queries go in blocks of at most BLOCK_ITEMS or about BLOCK_TERMS terms,
    which alone are on the driver and in the tasks; a block takes two passes
    over the documents, one for frequencies and one for bounds and scores. A
    task keeps ``top`` entries per query.
    """
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered, queries = _queries(items, query_col)
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_TERMS))
    found = None
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == part).where("size(terms) > 0").collect()
        n_docs, all_terms, df = _counted(pairs, {bytes(t) for r in rows for t in r.terms})
        weighted = [[(t, weight(n_docs, df[t])) for t in map(bytes, r.terms) if t in df] for r in rows]
        block = pairs.sparkSession.sparkContext.broadcast(Block([r.number for r in rows], weighted, n_docs, all_terms, coordinates, step_docs))

        def run(source: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for number, held in zip(block.value.numbers, best_of(source, block.value, top)):
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(held), pa.int64()), pa.array([e[2] for e in held], pa.int64()), pa.array([e[0] for e in held], pa.int64())],
                        ["number", "doc_id", "score"])

        hits = pairs.mapInArrow(run, "number long, doc_id long, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = batches.stage(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "search-hits")
        found = ranked if found is None else found.union(ranked)
    joined = found.join(batches.broadcast_if_small(numbered), "number")
    return joined.select(F.col("row").alias("item"), "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each benchmark item."""
    found = search(batches.table(spark, folder, "documents"), batches.table(spark, folder, "benchmark"))
    return found.select("item.item_id", "rank", "doc_id", "score")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERMS} AS term FROM docs) GROUP BY r, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
norms AS (SELECT r, 100 - 50 + ((50 * n * nd) // l) AS m FROM sizes, total),
wanted AS (SELECT DISTINCT q, term FROM (SELECT q, {_TERMS} AS term FROM items)),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM wanted) GROUP BY term), total),
scores AS (
  SELECT q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r) GROUP BY q, r),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 50
"""
