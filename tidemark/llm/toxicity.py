"""Toxicity by compression distance under two zstandard dictionaries.

The ordinary dictionary is trained on ordinary text. The toxic one holds the
same content and, after it, the stretches of toxic text that ordinary text
lacks; in the ordinary one zeros fill their place, so that all else is equally
far away. A window that compresses better by some bytes with the toxic
dictionary holds such a stretch; other windows compress alike. How far the
numbers of such windows exceed those of ordinary texts is turned into a score
by a logistic curve, calibrated on labelled texts that trained no dictionary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches
from .langid import fold

#: Labelled rows that are learned from, about, ...
TOXIC_ROWS, ORDINARY_ROWS = 2500, 4000
#: ... and about how many bytes of text at most.
SAMPLE_BYTES = 48 * 1024 * 1024
#: Share of the sample that trains the dictionaries; the rest calibrates.
TRAIN_SHARE = 0.6
#: Bytes of a window, and from one window's start to the next.
WINDOW, STEP = 48, 24
#: Bytes of the ordinary dictionary, and of the toxic text added to it.
ORDINARY_BYTES, TOXIC_BYTES = 65536, 16384
#: Bytes of the shortest match that a compressor may use.
MATCH = 5
HASH_BITS = 20
#: Lengths of the byte n-grams, within words, that toxic stretches consist of.
GRAMS = (6,)
#: An n-gram belongs to toxic text if it follows this many different words there
#: and its share there is this many times its share in ordinary text. Words that
#: a copy repeats after the same word count once.
LEAST_PLACES, LEAST_RATIO = 6, 20
#: Bytes saved from which on a window counts.
SAVINGS = (2, 3, 4, 5, 7)
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def normal(text: bytes) -> bytes:
    """Lower case, one blank between words and at both ends."""
    return b" %s " % b" ".join(text.decode().lower().encode().split())


def _hashes(text: bytes) -> np.ndarray:
    """A hash of the MATCH bytes from each place on."""
    codes = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(codes) - MATCH + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for i in range(MATCH):
        grams = grams << np.uint64(8) | codes[i : i + n]
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    #: Share of the windows of ordinary texts that save so many bytes.
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Score of every text if nothing could be learned.
    prior: float = 0.0

    def key(self) -> str:
        return hashlib.sha256(self.toxic + b"|" + self.ordinary).hexdigest()

    def counts(self, text: bytes) -> np.ndarray:
        """Windows by bytes saved, then all windows and the most bytes saved.

        Matches have MATCH bytes at least, so a window without as many bytes in
        common with the toxic stretches can't be shorter for them. It isn't
        compressed and counts as saving nothing; where the two lengths differ
        all the same, the compressor has searched another path.
        """
        plain, toxic, marks = _compressors(self)
        text = normal(text)
        starts = np.arange(0, max(1, len(text) - WINDOW + STEP), STEP)
        shared = np.concatenate([[0], np.cumsum(marks[_hashes(text)])])
        last = len(shared) - 1
        to_try = shared[np.minimum(starts + WINDOW - MATCH + 1, last)] > shared[np.minimum(starts, last)]
        saved = np.zeros(len(starts), dtype=np.int64)
        for k in np.flatnonzero(to_try):
            window = text[starts[k] : starts[k] + WINDOW]
            saved[k] = len(plain(window)) - len(toxic(window))
        return np.array([*((saved >= s).sum() for s in SAVINGS), len(saved), min(int(saved.max()), 12)], dtype=float)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """How surprising the counts are among ordinary texts, and the shares."""
        found, n, most = counts[:, : len(SAVINGS)], counts[:, -2:-1], counts[:, -1:]
        usual = n * self.usual
        surprise = found * np.log(np.maximum(found, 1) / usual) - (found - usual)
        surprise = np.sqrt(np.where(found > usual, np.minimum(surprise, 200), 0))
        return np.hstack([surprise, np.sqrt(found / n), most])

    def scores(self, texts: list[bytes]) -> list[float]:
        if not len(self.weights):
            return [self.prior] * len(texts)
        made = self.features(np.array([self.counts(t) for t in texts]).reshape(len(texts), -1))
        z = (made - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


_made: dict[str, tuple] = {}


def _compressors(model: Model) -> tuple:
    """The two compression functions and the toxic stretches' hashes, made once for each worker process."""
    key = model.key() if not hasattr(model, "_key") else model._key
    model._key = key
    if key not in _made:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=17, hash_log=17, search_log=8, min_match=MATCH, target_length=128,
            strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = []
        for content in (model.ordinary + bytes(len(model.toxic)), model.ordinary + model.toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)
        marks = np.zeros(1 << HASH_BITS, dtype=bool)
        marks[_hashes(model.toxic)] = True
        _made.clear()
        _made[key] = (*made, marks)
    return _made[key]


def _places(texts: list[bytes]) -> Counter:
    """For each word, with blanks around it, how many different words it follows."""
    seen: set[int] = set()
    words: Counter = Counter()
    for text in texts:
        before = b""
        for word in text.split():
            pair = hash((before, word))
            if pair not in seen:
                seen.add(pair)
                words[b" %s " % word] += 1
            before = word
    return words


def _grams(words: Counter, width: int, among=None) -> Counter:
    found: Counter = Counter()
    for word, n in words.items():
        for gram in {word[i : i + width] for i in range(len(word) - width + 1)}:
            if among is None or gram in among:
                found[gram] += n
    return found


def _stretches(word: bytes, marks: set[bytes]) -> list[bytes]:
    """The longest parts of a word that marks cover."""
    found, start, end = [], 0, 0
    for i in range(len(word) - min(GRAMS) + 1):
        longest = max((n for n in GRAMS if word[i : i + n] in marks), default=0)
        if longest:
            if i >= end:
                if end:
                    found.append(word[start:end])
                start = i
            end = min(len(word), max(end, i + longest))
    return [*found, word[start:end]] if end else found


def toxic_stretches(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Stretches within words that mark toxic texts, the most frequent last."""
    ours, theirs = _places(toxic), _places(ordinary)
    share = LEAST_RATIO * ours.total() / theirs.total()
    marks: set[bytes] = set()
    for width in GRAMS:
        often = {g: n for g, n in _grams(ours, width).items() if n >= LEAST_PLACES}
        usual = _grams(theirs, width, often)
        marks |= {g for g, n in often.items() if n >= share * (usual[g] + 1)}
    stretches: Counter = Counter()
    for word, n in ours.items():
        for stretch in _stretches(word, marks):
            stretches[stretch] += n
    kept = sorted((n, s) for s, n in stretches.items() if n >= LEAST_PLACES // 2)
    return b"".join(s for _, s in kept)[-TOXIC_BYTES:]


def ordinary_content(texts: list[bytes]) -> bytes:
    """A trained dictionary's content; plain text if there is too little to train on."""
    pieces = [t[i : i + 512] for t in texts for i in range(0, len(t), 512)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-ORDINARY_BYTES:]


def fit(rows: list[tuple[int, bytes, int]]) -> Model:
    """Train on (order number, text, 0 or 1); the first part of each kind trains the dictionaries.

    Empty texts are left out. With fewer than 20 texts of a kind, or none at
    all, the model gives every text the share of toxic ones, at most one half.
    Repeated rows count as often as they come; ties in the order number go by text.
    """
    rows = [(n, t, y) for n, t, y in rows if t.split()]
    labels = [y for *_, y in rows]
    model = Model(prior=sum(labels) / len(labels) if labels else 0.0)
    if min(Counter(labels).values(), default=0) < 20 or len(set(labels)) < 2:
        model.prior = min(model.prior, 0.5)
        return model
    parts: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for wanted in (0, 1):
        own = [t for _, t, y in sorted(rows) if y == wanted]
        cut = int(len(own) * TRAIN_SHARE)
        parts[wanted] = own[:cut], own[cut:]
    model.toxic = toxic_stretches([normal(t) for t in parts[1][0]], [normal(t) for t in parts[0][0]])
    model.ordinary = ordinary_content([normal(t) for t in parts[0][0]])
    texts = [(t, y) for y in (0, 1) for t in parts[y][1]]
    counts = np.array([model.counts(t) for t, _ in texts])
    y = np.array([y for _, y in texts], dtype=float)
    plain = counts[y == 0]
    model.usual = (plain[:, : len(SAVINGS)].sum(axis=0) + 1) / plain[:, -2].sum()
    made = model.features(counts)
    model.centre, model.scale = made.mean(axis=0), made.std(axis=0) + 1e-9
    x = np.column_stack([(made - model.centre) / model.scale, np.ones(len(made))])
    weights = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + 0.05 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    model.weights = weights
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> list[tuple[int, bytes, int]]:
    """About TOXIC_ROWS and ORDINARY_ROWS labelled texts outside the held-out fold, chosen by a hash.

    Labels are sampled first and are few, so that the join sends them to the
    documents. Null labels don't count; a document with several labels is toxic
    if one of them says so.
    """
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1)")
    if held_out:
        known = known.where(fold("doc_id", FOLDS) != HELD_OUT)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    share = {y: (most / sizes[y] if y in sizes else 0.0) for y, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))}
    chosen = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 30))
    few = batches.stage(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    texts = batches.stage(
        docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(place.alias("place"), "text", "toxic"), "toxicity-sample")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(SAMPLE_BYTES / size * (1 << 20)))
    return [(r.place, (r.text or "").encode(), r.toxic) for r in texts.collect()]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is likelier toxic) and ``predicted`` (1 from THRESHOLD on).

    A null or empty text is scored like one without any toxic window. If the
    labels did not suffice to learn (fewer than 20 of a kind), every score is
    their share, at most one half. Rows are scored one by one, so null or
    repeated ids change nothing; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def run(texts: list[bytes]) -> list[pa.Array]:
        scores = shared.value.scores(texts)
        return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]

    return batches.extend(docs, text_col, "score double, predicted int", run)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    A null doc_id is in no fold, so its row is not held out; labels with a null
    doc_id belong to no document.
    """
    docs = batches.table(spark, folder, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, batches.table(spark, folder, "labels")))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
