"""Removal of repeated lines, also of nearly equal ones, across all documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import batches, hamming
from .components import components

#: Lines with fewer words always stay: those without content.
LEAST_WORDS = 1
#: Bits in which the fingerprints of near lines may differ.
RADIUS = 3
#: Widths of the fingerprint's blocks. Three errors leave two of five blocks
#: equal, so any two blocks make a key.
BLOCKS = (13, 13, 13, 13, 12)
#: Least edit similarity of near lines, in characters: 1 - distance / longer length.
SIMILARITY = 0.8
#: Lines up to this length are compared without a look at their characters first.
SHORT = 100
#: Words whose bits are counted at once.
WORDS_AT_ONCE = 1 << 15

#: Punctuation, spaces and signs beyond ASCII in UTF-8: Latin-1 signs, general
#: punctuation, CJK punctuation and full-width forms (fixed values).
_SIGNS = re.compile(
    rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xc3[\x97\xb7]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]"
    rb"|\xe3\x80[\x80-\x83\x88-\x91\x94-\x9f]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xef\xbd[\x9b-\xa0]")
#: ASCII characters other than letters, digits, the underscore and line feeds, as blanks.
_BLANKS = bytes(c if c >= 0x80 or chr(c).isalnum() or c in (0x5F, 0x0A) else 0x20 for c in range(256))


def normalised_lines(text: bytes) -> list[list[bytes]]:
    """The lower-cased words of each line; punctuation and signs part words."""
    if text.isascii():
        text = text.lower()
    else:
        text = _SIGNS.sub(b" ", text.decode().lower().encode())
    return [line.split() for line in text.translate(_BLANKS).split(b"\n")]


def block_keys(fp: str = "fp") -> Column:
    """A key for each two blocks of a fingerprint."""
    parts, at = [], 0
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return F.array(*(
        F.shiftleft(parts[a], 17).bitwiseOR(F.shiftleft(parts[b], 4)).bitwiseOR(F.lit(n))
        for n, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))))


def with_block_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint once for each two of its blocks."""
    return fps.select(F.explode(block_keys()).alias("key"), "fp")


def fingerprints(lines: list[list[bytes]]) -> np.ndarray:
    """SimHash over the distinct words of each line; no line is empty.

    A word counts once, so that the frequent words of a language don't make the
    fingerprints of its long lines alike.
    """
    digest = xxhash.xxh64_digest
    out, part, size = [], [], 0

    def close():
        hashes = np.frombuffer(b"".join([digest(w) for words in part for w in words]), dtype=">u8").astype(np.uint64)
        lengths = np.array([len(words) for words in part])
        out.append(hamming.majority_bits(hashes, lengths))

    for words in lines:
        words = list(dict.fromkeys(words))
        part.append(words)
        size += len(words)
        if size >= WORDS_AT_ONCE:
            close()
            part, size = [], 0
    if part:
        close()
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def edit_distance(a: Sequence, b: Sequence, most: float = float("inf")) -> float:
    """Levenshtein distance, a bit per item of one sequence; anything over ``most`` if it is over."""
    start, shorter = 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        equal = places.get(c, 0)
        diagonal = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        rise = down | ~(flat | up) & full
        fall = up & flat
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - left > most:  # each item left takes away one at most
            return score
        rise, fall = rise << 1 | 1, fall << 1
        up = (fall | ~(diagonal | rise)) & full
        down = rise & diagonal & full
    return score


def similar(a: str, b: str, least: float) -> bool:
    longest = max(len(a), len(b))
    most = longest * (1 - least) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    if few_edits(a, b, most):
        return True
    if longest > SHORT:  # characters that one line has more often are edits at least
        extra, missing = Counter(a), Counter(b)
        if max((extra - missing).total(), (missing - extra).total()) > most:
            return False
    return edit_distance(a, b, most) <= most


def few_edits(a: str, b: str, most: float) -> bool:
    """Whether a look at the words shows a way of at most ``most`` edits from one line to the other."""
    if max(len(a), len(b)) <= most:
        return True
    ours, theirs = a.split(" "), b.split(" ")
    shorter, start, end = min(len(ours), len(theirs)), 0, 0
    while start < shorter and ours[start] == theirs[start]:
        start += 1
    while end < shorter - start and ours[-1 - end] == theirs[-1 - end]:
        end += 1
    ours, theirs = ours[start : len(ours) - end], theirs[start : len(theirs) - end]
    # what lies between the words that are equal at both ends, with its blanks, put anew
    if max(sum(map(len, part)) + len(part) for part in (ours, theirs)) <= most:
        return True
    return len(ours) == len(theirs) and sum(max(len(x), len(y)) for x, y in zip(ours, theirs) if x != y) <= most


def _copy() -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64("text")


def line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, copy, line_no, h1, h2, fp): a 128-bit hash and the fingerprint of every line."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, lines, halves = [], [], [], []
        for row, text in enumerate(batches.texts(batch.column(2))):
            for n, words in enumerate(normalised_lines(text)):
                if len(words) >= least_words:
                    rows.append(row), numbers.append(n), lines.append(words)
                    halves.append(xxhash.xxh3_128_digest(b" ".join(words)))
        hashes = np.frombuffer(b"".join(halves), dtype=">i8").astype(np.int64).reshape(-1, 2)
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(numbers, pa.int32()),
             pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(fingerprints(lines).view(np.int64))],
            ["doc_id", "copy", "line_no", "h1", "h2", "fp"])

    return batches.map_arrow(
        docs.select("doc_id", _copy().alias("copy"), "text"),
        f"doc_id {kind}, copy long, line_no int, h1 long, h2 long, fp long", run)


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, fp, h1, h2, words): cluster members, read again from the document of their first occurrence."""
    wanted = batches.stage(
        members.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.copy").alias("copy"))
        .agg(F.collect_list(F.struct("first.line_no", "h1", "h2", "fp", "cluster")).alias("wanted")),
        "lines-wanted")
    texts = docs.select("doc_id", _copy().alias("copy"), "text")
    # selective, so that Spark may test documents against a Bloom filter before it shuffles them
    small = batches.broadcast_if_small(wanted).where("size(wanted) > 0")
    joined = texts.join(
        small, texts.doc_id.eqNullSafe(small.doc_id) & (texts["copy"] == small["copy"])
    ).select("text", "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, wanted in zip(batches.texts(batch.column(0)), batch.column(1).to_pylist()):
            lines = normalised_lines(text)
            out += [(w["cluster"], w["fp"], w["h1"], w["h2"], b" ".join(lines[w["line_no"]]).decode()) for w in wanted]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "fp", "h1", "h2", "words"])

    return batches.map_arrow(joined, "key long, fp long, h1 long, h2 long, words string", run)


def spanning_near(fps: np.ndarray, words: list[str], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of a cluster's lines that are near, or similar to the first one."""
    lengths = np.array([len(w) for w in words])
    waiting, queue = np.arange(1, len(words)), [0]
    found, first = [], True
    while len(waiting):
        if not queue:
            queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            longest = np.maximum(lengths[waiting], lengths[at])
            to_try = np.abs(lengths[waiting] - lengths[at]) <= longest * (1 - least) + 1e-9
            if not first:
                to_try &= np.bitwise_count(fps[waiting] ^ fps[at]) <= RADIUS
            first = False
            near = [int(i) for i in waiting[to_try] if similar(words[at], words[i], least)]
            if near:
                found += [(at, i) for i in near]
                queue += near
                waiting = waiting[~np.isin(waiting, near)]
    return found


def _node() -> Column:
    return F.struct("h1", "h2")


NODE = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])


def near_links(docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the near lines.

    Nodes are pairs of hash halves. Lines whose fingerprints are connected over
    links of at most RADIUS bits make a cluster; its first line is the one with
    the smallest hash. In a cluster of any size a line is near the first one if
    their edit similarity is enough, and near another one if, besides, they
    differ in at most RADIUS bits. So a large group of near lines takes about one
    comparison a line. A cluster over hamming.TILE lines is held against its
    first line by many tasks; what is left meets the others over equal blocks.
    """
    names = ["key", "fp", "h1", "h2", "words", "a", "b"]
    node = "struct<h1: long, h2: long>"
    schema = f"key long, fp long, h1 long, h2 long, words string, a {node}, b {node}"

    def search(rows: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(rows).combine_chunks()
        found = spanning_near(
            rows.column(1).to_numpy().view(np.uint64), rows.column(4).to_pylist(), similarity)
        halves = [rows.column(i).to_numpy() for i in (2, 3)]
        return [np.array([half[pair[end]] for pair in found], dtype=np.int64) for end in (0, 1) for half in halves]

    def emit(found: list) -> pa.RecordBatch:
        halves = [pa.array(np.concatenate(part)) for part in zip(*found)]
        ends = [pa.StructArray.from_arrays(halves[i : i + 2], fields=list(NODE)) for i in (0, 2)]
        n = len(ends[0])
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.string()), *ends], names)

    def spill(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([r.column(i) for r in rows]) for i in range(5)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(columns[0]), NODE)] * 2], names)

    fps = batches.stage(distinct.groupBy("fp").agg(F.count("*").alias("n")), "lines-fps")
    linked = batches.stage(hamming.linked(fps, with_block_keys, RADIUS, "lines"), "lines-linked")
    # clusters of two lines or more: linked fingerprints, and those of several lines
    clusters = fps.join(batches.broadcast_if_small(linked), "fp", "left").where((F.col("n") > 1) | F.col("group").isNotNull())
    clusters = batches.stage(clusters.select("fp", F.coalesce("group", "fp").alias("cluster")), "lines-clusters")
    placed = distinct.join(batches.broadcast_if_small(clusters), "fp").select("h1", "h2", "fp", "first", "cluster")
    texts = _with_texts(docs, placed)
    found = batches.stage(
        texts.repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(hamming.search_runs(search, emit, spill), schema), "lines-found")
    links = found.where("key is null").select("a", "b")
    hot = found.where("key is not null").select("key", "fp", "h1", "h2", "words")
    heads = batches.stage(hot.groupBy("key").agg(F.min(F.struct("h1", "h2", "words")).alias("head")), "lines-heads")
    with_head = hot.join(batches.broadcast_if_small(heads), "key").select(*hot.columns, "head")
    judged = batches.stage(_near_head(with_head, similarity), "lines-judged")
    links = links.union(judged.where("near").select(F.struct("head.h1", "head.h2").alias("a"), _node().alias("b")))
    rest = judged.where("not near").drop("near", "head")
    if not rest.isEmpty():
        others = judged.select("key", F.col("fp").alias("other_fp"), F.struct("h1", "h2", "words").alias("head"), block_keys().alias("other_keys"))
        others = others.withColumn("block", F.explode("other_keys"))
        mine = rest.withColumn("keys", block_keys()).withColumn("block", F.explode("keys"))
        # a pair meets in one of the blocks it shares
        close = F.expr(f"""bit_count(fp ^ other_fp) <= {RADIUS} AND block = array_min(array_intersect(keys, other_keys))
            AND NOT (h1 = head.h1 AND h2 = head.h2)""")
        pairs = mine.join(others, ["key", "block"]).where(close).select("key", "fp", "h1", "h2", "words", "head")
        more = _near_head(pairs, similarity).where("near")
        links = links.union(more.select(F.struct("head.h1", "head.h2").alias("a"), _node().alias("b")))
    # a row that repeats id and text gives its lines again, hence links from a line to itself
    return links.where("a != b")


def _near_head(lines: DataFrame, least: float) -> DataFrame:
    """``lines`` with ``near``: whether the words are similar to those of ``head``."""
    at, to = lines.columns.index("words"), lines.columns.index("head")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        others = batch.column(to).field("words").to_pylist()
        near = [similar(a, b, least) for a, b in zip(batch.column(at).to_pylist(), others)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.bool_())], [*batch.schema.names, "near"])

    return batches.map_arrow(lines, StructType([*lines.schema.fields, StructField("near", BooleanType())]), run)


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy, dropped): the numbers of the lines to drop, for documents that have any.

    Of each group of equal or near lines the occurrence with the smallest
    (doc_id, copy, line number) stays; ``copy`` is a hash of the whole text.
    """
    lines = batches.stage(line_table(docs, least_words), "lines")
    place = F.struct("doc_id", "copy", "line_no")
    distinct = batches.stage(
        lines.groupBy("h1", "h2").agg(F.first("fp").alias("fp"), F.min(place).alias("first"), F.count("*").alias("n")), "lines-distinct")
    found = components(near_links(docs, distinct, similarity), "lines-groups")
    found = batches.stage(found.select(F.col("node.*"), F.col("component").alias("near")), "lines-near")
    grouped = distinct.join(batches.broadcast_if_small(found), ["h1", "h2"], "left").where("n > 1 OR near IS NOT NULL")
    grouped = batches.stage(grouped.select("h1", "h2", F.coalesce("near", _node()).alias("group"), "first"), "lines-grouped")
    kept = batches.stage(grouped.groupBy("group").agg(F.min("first").alias("kept")), "lines-kept")
    verdicts = batches.stage(grouped.join(kept, "group").select("h1", "h2", "kept"), "lines-verdicts")
    gone = lines.join(batches.broadcast_if_small(verdicts), ["h1", "h2"]).where(~place.eqNullSafe(F.col("kept")))
    return batches.stage(
        gone.groupBy("doc_id", "copy").agg(F.collect_set("line_no").alias("dropped")), "lines-gone")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``dropped`` (line numbers).

    Lines are cut at line feeds and compared by their lower-cased words; lines
    of fewer than ``least_words`` words always stay, as do null and empty
    texts. Ties go to the smallest (doc_id, line number); a null doc_id is the
    smallest. Rows that repeat both id and text keep the same lines; rows that
    repeat only the id count as different documents. A document may end up
    empty, but no row is removed. ``n_chars``, if there, is set anew; columns
    named like the new ones are replaced.
    """
    gone = batches.broadcast_if_small(repeated_lines(docs, least_words, similarity))
    kept = docs.drop("n_lines", "dropped")
    joined = kept.join(
        gone, kept.doc_id.eqNullSafe(gone.doc_id) & (F.xxhash64(kept.text) == gone["copy"]), "left"
    ).select(*(kept[c] for c in kept.columns), "dropped")
    names = joined.columns
    text_at, gone_at = names.index("text"), names.index("dropped")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts, counts, drops = [], [], []
        for text, gone in zip(columns[text_at].to_pylist(), columns[gone_at].to_pylist()):
            lines = [] if text is None else text.split("\n")
            drops.append(sorted(gone or []))
            counts.append(len(lines))
            if gone:
                gone = set(gone)
                text = "\n".join(line for n, line in enumerate(lines) if n not in gone)
            texts.append(text)
        columns[text_at] = pa.array(texts, columns[text_at].type)
        columns[gone_at] = pa.array(drops, pa.list_(pa.int32()))
        if "n_chars" in names:
            at = names.index("n_chars")
            columns[at] = pa.array([None if t is None else len(t) for t in texts], columns[at].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_lines"])

    return batches.map_arrow(joined, StructType([*joined.schema.fields, StructField("n_lines", LongType())]), run)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, in the same columns; see ``dedup_lines``.

    No row goes, ``n_chars`` follows the text, and all other columns stay as they
    are, also those named like the columns that ``dedup_lines`` adds.
    """
    aside = {c: f"_aside_{c}" for c in ("n_lines", "dropped") if c in docs.columns}
    cleared = dedup_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "dropped")
    return cleared.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, dropped line numbers and remaining text of every document."""
    docs = batches.table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "dropped", "text")
