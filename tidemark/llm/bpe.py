"""Byte-level BPE: encoding by a queue of merges, decoding by concatenation."""

from __future__ import annotations

import hashlib
import json
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from . import batches

#: How a text is split before merging (fixed value of this tokenizer family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task remembers, in each of two generations.
REMEMBERED = 250_000
#: Longer pieces are encoded each time.
REMEMBERED_CHARS = 64
#: Pieces up to this length are merged without a queue.
FEW_BYTES = 24
#: Characters that are cut into pieces at once; a longer text is cut on its own.
CHARS_AT_ONCE = 1 << 20

#: Classes of characters as PATTERN tells them apart.
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    chars = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    found = np.zeros(len(chars), dtype=np.uint8)
    for match in regex.finditer(r"(\p{L}+)|(\p{N}+)|(\s+)", chars):
        found[match.start() : match.end()] = match.lastindex
    return np.concatenate([found[:0xD800], np.zeros(0x800, np.uint8), found[0xD800:]])


def piece_starts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where PATTERN cuts a run of texts, of which each starts where ``fresh`` is set; as flags."""
    kind = classes()[points]
    cut = fresh.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # white space before another character leaves its last character, which, if a blank, joins what follows
    at = np.flatnonzero(cut[1:] & ~fresh[1:] & (kind[:-1] == SPACE)) + 1
    cut[at - 1] = True
    cut[at[points[at - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a piece and some letters behind it
    at = np.flatnonzero(cut & (points == 0x27))
    ahead = np.concatenate([points, np.zeros(3, points.dtype)])
    over = np.concatenate([fresh, np.ones(3, bool)])  # the text ends before
    first, second = ahead[at + 1], ahead[at + 2]
    short = ~over[at + 1] & np.isin(first, [ord(c) for c in "stmd"])
    long = ~over[at + 1] & ~over[at + 2] & (
        np.isin(first, [ord(c) for c in "rv"]) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
    cut = np.concatenate([cut, np.zeros(3, bool)])
    cut[at[short | long] + 1] = False
    cut[at[short] + 2] = True
    cut[at[long] + 3] = True
    return cut[:-3]


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = {i: as_bytes(t) for t, i in vocabulary.items() if t not in self.special}
        self.words |= {i: t.encode() for t, i in self.special.items()}
        ids = {word: i for i, word in self.words.items()}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.rules: list[tuple[int, int, int]] = []  # by rank: left, right, made
        self.ranks: dict[int, int] = {}
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            rule = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.ranks.setdefault(rule[0] << 32 | rule[1], len(self.rules))
            self.rules.append(rule)
        self.pieces = regex.compile(PATTERN).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merge the symbols of a piece, lowest rank first and leftmost among equals."""
        of_byte, rank_of, rules = self.of_byte, self.ranks.get, self.rules
        symbols = [of_byte[b] for b in data]
        last = len(symbols)
        # an entry is rank * length + place: one number sorts by both
        queue = [
            rank * last + i
            for i in range(last - 1)
            if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None
        ]
        heapify(queue)
        after = list(range(1, last + 1))
        before = list(range(-1, last - 1))
        while queue:
            rank, i = divmod(heappop(queue), last)
            left, right, made = rules[rank]
            j = after[i]
            if symbols[i] != left or j >= last or symbols[j] != right:
                continue  # stale: one of the two symbols has been merged since
            k = after[i] = after[j]
            symbols[i], symbols[j] = made, -1
            if k < last:
                before[k] = i
                if (rank := rank_of(made << 32 | symbols[k])) is not None:
                    heappush(queue, rank * last + i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << 32 | made)) is not None:
                heappush(queue, rank * last + h)
        return tuple([s for s in symbols if s >= 0])

    def merge_short(self, data: bytes) -> tuple[int, ...]:
        """As ``merge``; in a piece of few symbols a look at all ranks is faster than a queue of them."""
        rank_of, rules, none = self.ranks.get, self.rules, len(self.rules)
        symbols = [self.of_byte[b] for b in data]
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            made = symbols[i] = rules[rank][2]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(made << 32 | symbols[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << 32 | made, none)
        return tuple(symbols)

    def _missing(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            ids = self.merge_short(data) if len(data) <= FEW_BYTES else self.merge(data)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.splits.split(text) if self.splits else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces(part):
                out += self.new.get(piece) or self._missing(piece)
        return out

    def _encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, marks = texts, []
        whole = "".join(texts)
        if any(token in whole for token in self.special):
            parts, marks, at = [], [], 0
            for text in texts:
                for part in self.splits.split(text):
                    if part in self.special:
                        marks.append((at, at + len(part)))
                    parts.append(part)
                    at += len(part)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        fresh = np.zeros(len(points) + 1, dtype=bool)
        fresh[np.cumsum([0, *map(len, parts)])] = True
        cut = piece_starts(points, fresh[:-1])
        for start, end in marks:
            cut[start + 1 : end] = False
        starts = np.flatnonzero(cut)
        data = whole.encode()
        offsets = starts
        if len(data) > len(points):
            widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            offsets = (np.cumsum(widths) - widths)[starts]
        offsets = np.append(offsets, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = self.new.get
        of_piece = [
            (self.special[piece],) if marks and piece in self.special else known(piece) or self._missing(piece)
            for piece in pieces.dictionary.to_pylist()]
        counts = np.array([len(ids) for ids in of_piece], dtype=np.int64)
        values = np.fromiter(chain.from_iterable(of_piece), dtype=np.int32, count=counts.sum())
        which = pieces.indices.to_numpy()
        lengths = counts[which]
        ends = np.append(0, np.cumsum(lengths))
        ids = values[np.repeat((np.cumsum(counts) - counts)[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, np.cumsum([0, *map(len, texts)]))]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """As ``encode`` for many texts; each distinct piece of some of them is looked up once."""
        out: list[np.ndarray] = []
        held, size = [], 0
        for text in [*texts, None]:
            if held and (text is None or size + len(text) > CHARS_AT_ONCE):
                ids, ends = self._encode_some(held)
                out += [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
                held, size = [], 0
            if text is None:
                continue
            if len(text) > CHARS_AT_ONCE:
                out.append(np.array(self.encode(text), dtype=np.int32))
            else:
                held.append(text)
                size += len(text)
        return out

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        """The vocabulary's bytes of each list of ids, joined; not always valid UTF-8, unlike what ``decode`` gives."""
        if not hasattr(self, "table"):
            self.table = pa.array([self.words.get(i, b"") for i in range(max(self.words) + 1)], pa.large_binary())
        out: list[bytes] = []
        for at in range(0, len(lists), 64):
            some = lists[at : at + 64]
            found = self.table.take(pa.array(np.concatenate(some)))
            offsets = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1)
            cuts = offsets[np.cumsum([0, *map(len, some)])].tolist()
            data = memoryview(found.buffers()[2] or b"")
            out += [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        return out

    def decode(self, ids: list[int]) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode("utf-8", "replace")


@cache
def codec(source: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(source)


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text, read once on the driver; a few megabytes at most."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def id_arrays(lists: list[np.ndarray]) -> list[pa.Array]:
    """Lists of ids and their lengths as columns."""
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    ids = np.concatenate([np.empty(0, np.int32), *lists])
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(counts)]


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``n_tokens`` of each whole text.

    Strings of special tokens in a text become their ids. A null text counts as
    empty and has no ids. Each row is encoded on its own, so repeated rows and
    null ids change nothing; columns named like the new ones are replaced.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(texts: list[bytes]) -> list[pa.Array]:
        return id_arrays(codec(source.value).encode_all([t.decode() for t in texts]))

    return batches.extend(docs, text_col, "token_ids array<int>, n_tokens long", run)


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each row's ids; null ids give an empty text.

    An id outside the vocabulary is an error. A column named ``text_col`` is replaced.
    """
    source = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept = tokens.drop(text_col)
    at = kept.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([codec(source.value).decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, text_col])

    return batches.map_arrow(kept, StructType([*kept.schema.fields, StructField(text_col, StringType())]), run)


def encode_checked(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """As ``encode``, with ``round_trip``: whether the decoded ids give the text again.

    A null or empty text has no ids and comes back as empty text, so its
    ``round_trip`` is true. A column named ``round_trip`` is replaced, too.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(texts: list[bytes]) -> list[pa.Array]:
        own = codec(source.value)
        ids = own.encode_all([t.decode() for t in texts])
        same = [made == t for made, t in zip(own.decode_all(ids), texts)]  # the texts are valid UTF-8
        return [*id_arrays(ids), pa.array(same, pa.bool_())]

    return batches.extend(docs, text_col, "token_ids array<int>, n_tokens long, round_trip boolean", run)


def op2_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every document."""
    docs = batches.table(spark, folder, "documents").select("doc_id", "text")
    source = spark.sparkContext.broadcast(read_vocabulary())

    def run(texts: list[bytes]) -> list[pa.Array]:
        own = codec(source.value)
        names = getattr(own, "names", None)
        if names is None:
            names = own.names = {i: str(i) for i in own.words}
        counts, of_ids, of_texts = [], [], []
        for text in texts:
            ids = own.encode(text.decode())
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            of_texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    return batches.extend(docs, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", run).drop("text")
