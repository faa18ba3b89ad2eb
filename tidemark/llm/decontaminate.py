"""Training documents that hold passages of a benchmark, also edited ones."""

from __future__ import annotations

import re
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from . import batches

#: Words of a seed.
WIDTH = 3
#: Alignment scores: equal words, different words, a word left out.
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
#: Least score for each word of the item.
THRESHOLD = 0.5
#: Benchmark items in one pass over the documents; more items take more passes.
BLOCK_ITEMS = 20_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the passage position after its last word."""
    ramp = np.arange(len(passage) + 1) * GAP
    before = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.maximum(before - GAP, 0.0)
        row[1:] = np.maximum(row[1:], before[:-1] + np.where(passage == word, MATCH, MISMATCH))
        # words of the passage left out: the best start to the left less its distance
        before = np.maximum.accumulate(row + ramp) - ramp
        at = int(before.argmax())
        if before[at] > best:
            best, end = float(before[at]), at
    return best, end


class Block:
    """Some benchmark rows with their seeds: all word trigrams, frequent or not.

    Rows are told apart by their place, so several texts may have one item_id.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [item_id for item_id, _ in items]
        self.items: dict[int, np.ndarray] = {}
        self.number: dict[str, int] = {}
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        #: Items too short for a seed, by their words.
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for row, (_, text) in enumerate(items):
            words = words_of(text or "")
            if len(words) < WIDTH:
                if words:
                    self.short[tuple(words)].append(row)
                continue
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            self.items[row] = np.array(ids)
            for at, gram in enumerate(zip(*(ids[i:] for i in range(WIDTH)))):
                self.seeds[gram].append((row, at))

    def lines(self, text: str) -> list[tuple[int | None, float, int, int]]:
        """The short items that are a line of their own."""
        out, at = {}, 0
        for line in text.split("\n"):
            words = tuple(words_of(line))
            for row in self.short.get(words, ()):
                out.setdefault(row, (self.ids[row], 1.0, at, at + len(words)))
            at += len(words)
        return list(out.values())

    def found(self, text: str) -> list[tuple[int | None, float, int, int]]:
        """(item, score for each word, first word, end) of the items aligned in a text."""
        numbers = [self.number.get(w, -1) for w in words_of(text)]
        seeds = self.seeds
        starts = defaultdict(list)
        for at, gram in enumerate(zip(*(numbers[i:] for i in range(WIDTH)))):
            if gram in seeds:
                for row, place in seeds[gram]:
                    starts[row].append(at - place)
        words, out = np.array(numbers), self.lines(text) if self.short else []
        for row, at in starts.items():
            item = self.items[row]
            best = (0.0, 0, 0)
            for low, high in _windows(sorted(at), len(item), len(words)):
                passage = words[low:high]
                if not may_align(item, passage):
                    continue
                score, end = smith_waterman(item, passage)
                if score > best[0]:
                    best = score, low, end
            score, low, end = best
            if score / len(item) >= THRESHOLD:
                # the same alignment backwards ends where it starts
                back = smith_waterman(item[::-1], words[low : low + end][::-1])[1]
                out.append((self.ids[row], min(1.0, score / len(item)), low + end - back, low + end))
        return sorted(out, key=lambda hit: (hit[0] is not None, hit[0] or 0, hit[1:]))


def may_align(item: np.ndarray, passage: np.ndarray) -> bool:
    """Whether the words in common allow an alignment that reaches the threshold.

    An alignment scores at most MATCH for each word in common. One that reaches
    the threshold leaves out so few words of the passage that it lies within
    ``reach`` words, so the words in common are counted in windows of that
    width, each word as often as the item has it. Never False for a match.
    """
    length = len(item)
    least = THRESHOLD * length / MATCH
    at = np.flatnonzero(np.isin(passage, item))
    if len(at) < least:
        return False
    reach = length + int((MATCH - THRESHOLD) * length / GAP)
    if (np.arange(1, len(at) + 1) - np.searchsorted(at, at - reach, "right")).max() < least:
        return False
    words, times = np.unique(item, return_counts=True)
    kinds = np.searchsorted(words, passage[at])
    order = np.argsort(kinds, kind="stable")
    by_word, places = kinds[order], at[order]
    # a word counts in windows that begin after the same word as many times
    # before as the item has it
    rank = np.arange(len(order))
    earlier = rank - times[by_word]
    same = (earlier >= 0) & (by_word[earlier] == by_word)
    first = np.maximum(np.where(same, places[earlier] + 1, 0), np.maximum(places - reach + 1, 0))
    counts = np.bincount(first, minlength=len(passage) + 1) - np.bincount(places + 1, minlength=len(passage) + 1)
    return bool(np.cumsum(counts).max() >= least)


def _windows(starts: list[int], length: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document that reach an item's length around its seeds."""
    low = high = None
    for start in starts:
        a, b = max(0, start - length // 2), min(most, start + length + length // 2)
        if high is not None and a <= high:
            high = max(high, b)
        else:
            if high is not None:
                yield low, high
            low, high = a, b
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's rows, equal ones once, in parts of about BLOCK_ITEMS rows."""
    items = batches.stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "benchmark")
    n = max(1, -(-items.count() // BLOCK_ITEMS))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text") for i in range(n)]


HITS = ArrayType(StructType([
    StructField("item_id", LongType()), StructField("score", DoubleType()),
    StructField("first_word", LongType()), StructField("end_word", LongType()),
]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``hits``: the benchmark items found in each whole text, with score and words.

    A null or empty text has no hits, and neither has an item without words.
    Items of fewer than three words would be found by chance anywhere, so they
    count where they are a line of their own. Rows that repeat an item_id with
    another text are items of their own, as are those with a null one. Documents are judged row
    by row, so null or repeated ids change nothing. A column named ``hits`` is
    replaced. Of a large benchmark one block of rows at a time is on the driver
    and in the tasks; what it finds is written before the next one.
    """
    kept = docs.drop("hits")
    found = kept
    parts = blocks(benchmark)
    for n, part in enumerate(parts):
        block = docs.sparkSession.sparkContext.broadcast(Block([(r.item_id, r.text) for r in part.collect()]))
        at = found.columns.index(text_col)

        def run(batch: pa.RecordBatch, block=block, at=at, n=n) -> pa.RecordBatch:
            hits = [
                [dict(zip(("item_id", "score", "first_word", "end_word"), h)) for h in block.value.found(t.decode())]
                for t in batches.texts(batch.column(at))
            ]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
            columns, names = list(batch.columns), list(batch.schema.names)
            if n:  # later blocks add to what earlier ones found
                hits = [a + b for a, b in zip(columns[-1].to_pylist(), hits)]
                columns, names = columns[:-1], names[:-1]
            return pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], [*names, "hits"])

        found = batches.map_arrow(found, StructType([*kept.schema.fields, StructField("hits", HITS)]), run)
        if n < len(parts) - 1:
            found = batches.stage(found, "leaks")
            block.destroy()
    return found


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, in the same columns; see ``find_leaks``."""
    found = find_leaks(docs.select(F.struct(*docs.columns).alias("row"), "text"), benchmark)
    return found.where("size(hits) = 0").select("row.*")


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, contaminated, best score and all found items of every document."""
    docs = batches.table(spark, folder, "documents").select("doc_id", "text")
    found = find_leaks(docs, batches.table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.array_max("hits.score"), F.lit(0.0)).alias("best_score"),
        F.col("hits.item_id").alias("item_ids"), "hits",
    )
