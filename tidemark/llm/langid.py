"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations


import sys
from dataclasses import dataclass
from functools import cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

#: Bins of hashed character n-grams.
BINS = 4096
#: Lengths of the n-grams.
WIDTHS = (1, 2, 3)
#: Documents whose vectors the centroids are fitted on, over all languages.
SAMPLE_ROWS = 6000
#: Centroids per language.
CENTROIDS = 4
#: A text is rejected if it is further from its centroid than this share of the
#: fitted documents, ...
REJECT_SHARE = 0.002
#: ... and its cosine is below this fraction of theirs.
REJECT_SLACK = 0.7
#: Characters whose n-grams are counted at once.
CHARS_AT_ONCE = 1 << 20
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], dtype=np.uint32)


def ngram_counts(text: bytes) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters; None without a letter.

    A run of other characters counts as one blank; n-grams of blanks only are left out.
    """
    codes = np.frombuffer(text.decode().lower().encode("utf-32-le"), dtype=np.uint32)
    codes = _letters()[codes]
    if not codes.any():
        return None
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    counts = np.zeros(BINS, dtype=np.int64)
    longest = max(WIDTHS)
    for at in range(0, len(codes), CHARS_AT_ONCE):
        part = codes[at : at + CHARS_AT_ONCE + longest - 1]
        for width in WIDTHS:
            n = min(len(part) - width + 1, CHARS_AT_ONCE)
            if n <= 0:
                continue
            mixed = np.full(n, width, dtype=np.uint64)
            any_letter = np.zeros(n, dtype=bool)
            for i in range(width):
                mixed = (mixed ^ part[i : i + n]) * _MIX[i]
                any_letter |= part[i : i + n] != 0
            bins = (mixed >> np.uint64(64 - 12)).astype(np.int64)
            counts += np.bincount(bins[any_letter], minlength=BINS)
    return counts


@dataclass
class Model:
    """Fitted centroids: one row each, with its language and lowest accepted cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    lowest: np.ndarray

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        raw = np.sqrt(np.array(counts, dtype=np.float32)) * self.idf
        return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        counts = {i: c for i, t in enumerate(texts) if t and (c := ngram_counts(t)) is not None}
        if counts and len(self.langs):
            cosines = self.vectors(list(counts.values())) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for row, (i, c) in enumerate(zip(counts, best)):
                cosine = float(min(1.0, max(0.0, cosines[row, c])))
                langs[i], scores[i], rejected[i] = self.langs[c], cosine, cosine < self.lowest[c]
        return langs, scores, rejected


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def cluster(vectors: np.ndarray, most: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from far-apart starts; at most ``most`` unit centroids."""
    centres = [vectors.mean(axis=0)]
    centres[0] /= np.linalg.norm(centres[0])
    while len(centres) < min(most, len(vectors)):
        # the farthest twentieth's mean, so that a single odd text makes no centroid
        nearest = (vectors @ np.array(centres).T).max(axis=1)
        far = vectors[np.argsort(nearest)[: max(1, len(vectors) // 20)]].mean(axis=0)
        centres.append(far / max(np.linalg.norm(far), 1e-12))
    found = np.array(centres)
    for _ in range(rounds):
        own = (vectors @ found.T).argmax(axis=1)
        sums = np.array([vectors[own == c].sum(axis=0) for c in range(len(found)) if (own == c).any()])
        found = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Fit on rows of (id, text, lang); rows without a language or a letter don't count.

    Document frequencies cover all rows. The centroids are fitted on about
    ``sample_rows`` rows, as many of each language, chosen by a hash of the id;
    only these rows' count vectors reach the driver. Rows with one id are chosen
    together, those with a null id as one; other columns are not read. Without
    any row that counts the model has no centroids and predicts ``und``.
    """
    docs = docs.select(F.col("id").cast("string"), "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    share = {lang: sample_rows / len(sizes) / n for lang, n in sizes.items()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS + 1, dtype=np.int64)  # the last: documents
        names = ["lang", "bins", "counts"]
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in source:
            chosen: list[list] = [[], [], []]
            picks = batch.column(0).to_pylist()
            langs = batch.column(2).to_pylist()
            for pick, text, lang in zip(picks, batches.texts(batch.column(1)), langs):
                counts = ngram_counts(text)
                if counts is None:
                    continue
                seen[:-1] += counts > 0
                seen[-1] += 1
                if pick < share[lang]:
                    at = counts.nonzero()[0]
                    for column, value in zip(chosen, (lang, at, counts[at])):
                        column.append(value)
            if chosen[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(chosen, kinds)], names)
        last = ([None], [np.arange(BINS + 1)], [seen])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(last, kinds)], names)

    pick = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("pick")
    found = batches.stage(
        docs.select(pick, "text", "lang").mapInArrow(run, "lang string, bins array<int>, counts array<long>"), "langid")
    seen = np.zeros(BINS + 1)
    frequencies = (
        found.where("lang is null").select(F.inline(F.arrays_zip("bins", "counts")))
        .groupBy("bins").agg(F.sum("counts").alias("n"))
    )
    for r in frequencies.collect():  # one row for each bin
        seen[r.bins] = r.n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + np.float32(0.1)
    model = Model(idf, np.zeros((0, BINS), np.float32), [], np.zeros(0))
    rows: dict[str, list[np.ndarray]] = {}
    for r in found.where("lang is not null").orderBy("lang", F.xxhash64("bins", "counts")).toLocalIterator():
        counts = np.zeros(BINS, dtype=np.float32)
        counts[r.bins] = r.counts
        rows.setdefault(r.lang, []).append(counts)
    parts, lowest = [], []
    for lang in sorted(rows):
        vectors = model.vectors(rows.pop(lang))
        centres = cluster(vectors, centroids)
        cosines = vectors @ centres.T
        bound = float(np.quantile(cosines.max(axis=1), REJECT_SHARE)) * REJECT_SLACK
        parts.append(centres)
        model.langs += [lang] * len(centres)
        lowest += [bound] * len(centres)
    if parts:
        model.centroids = np.concatenate(parts).astype(np.float32)
        model.lowest = np.array(lowest)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``.

    A null text, a text without a letter and any text under a model without
    centroids get ``und``, score 0 and are rejected. Ties go to the language
    first in order. Rows are judged one by one, so null or repeated ids change
    nothing; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids and idf only

    def run(texts: list[bytes]) -> list[pa.Array]:
        langs, scores, rejected = shared.value.predict(texts)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    return batches.extend(docs, text_col, "lang_pred string, score double, rejected boolean", run)


def learnable(docs: DataFrame) -> DataFrame:
    """The labelled documents outside the held-out fold, as (id, text, lang)."""
    return docs.where(fold("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").alias("id"), "text", "lang")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is identified; a null ``lang`` is filled in.

    Texts that are too far from every learned language go, and so do those
    without a letter, null and empty ones among them. If no row has a ``lang``
    there is nothing to learn, and all documents stay as they are. Repeated rows
    and null ids are judged by their texts; an empty table gives an empty one.
    """
    fitted = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    if not len(fitted.langs):
        return docs
    model = spark.sparkContext.broadcast(fitted)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, _, rejected = model.value.predict(batches.texts(batch.column(text_at)))
        columns = list(batch.columns)
        columns[lang_at] = pc.coalesce(columns[lang_at], pa.array(langs, columns[lang_at].type))
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array([not r for r in rejected]))

    return batches.map_arrow(docs, docs.schema, run)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the method's rejection for every document.

    A null doc_id is in no fold: its row is neither held out nor learned from.
    """
    docs = batches.table(spark, folder, "documents")
    judged = identify(docs.select("doc_id", "text"), fit(learnable(docs)))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "rejected")
