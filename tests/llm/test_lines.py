import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import batches, hamming, lines
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_edit_distance(a, b):
    assert lines.edit_distance(a, b) == plain_distance(a, b)
    assert min(lines.edit_distance(a, b, 3), 4) == min(plain_distance(a, b), 4)


def test_fingerprints_equal_a_plain_count():
    rng = random.Random(11)
    made = [[b"w%d" % i for i in rng.sample(range(900), n)] for n in (1, 2, 3, 60, 254, 255, 256, 700, 5)]
    made += [words + words[: len(words) // 2] for words in made]  # repeats of a word count once
    for words, got in zip(made, lines.fingerprints(made).tolist()):
        hashes = [xxhash.xxh64_intdigest(w) for w in set(words)]
        assert got == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def dropped_by_brute_force(rows, bits=True):
    """{(id, text): dropped line numbers} by comparing all lines; without ``bits`` by edit similarity alone."""
    first = {}
    places = []
    for i, text in rows:
        for n, words in enumerate(lines.normalised_lines((text or "").encode())):
            if words:
                key = b" ".join(words).decode()
                places.append((key, (i, n), text))
                first[key] = min(first.get(key, (i, n)), (i, n))
    keys = sorted(first, key=first.get)
    fps = [int(lines.fingerprints([k.encode().split()])[0]) for k in keys]
    near_bits = lambda a, b: bin(a ^ b).count("1") <= lines.RADIUS
    hashes = [xxhash.xxh3_128_digest(k.encode()) for k in keys]
    halves = [tuple(int.from_bytes(h[i : i + 8], "big", signed=True) for i in (0, 8)) for h in hashes]
    cluster = brute.groups(list(range(len(keys))), lambda a, b: near_bits(fps[a], fps[b]))
    heads = {}
    for n, c in enumerate(cluster):
        heads[c] = min(heads.get(c, n), n, key=lambda m: halves[m])

    def near(a, b):
        if bits and not (near_bits(fps[a], fps[b]) or cluster[a] == cluster[b] and heads[cluster[a]] in (a, b)):
            return False
        return 10 * plain_similar(keys[a], keys[b]) >= 8

    group = brute.groups(list(range(len(keys))), near)
    kept = {k: first[keys[group[n]]] for n, k in enumerate(keys)}
    gone = {}
    for key, place, text in places:
        if kept[key] != place:
            gone.setdefault((place[0], text), set()).add(place[1])
    return gone


def plain_similar(a, b):
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > 0.2 * longest:
        return 0
    return (1 - lines.edit_distance(a, b) / longest) + 1e-9


def made_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(25)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = word()
            text.append(" ".join(words) + rng.choice(["", ".", "!! "]))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("tile", [2048, 4])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(hamming, "TILE", tile)
    batches.session(spark)
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in df.collect()}
    assert len(got) == len(rows)
    found = lines.dedup_lines(df).collect()
    want = dropped_by_brute_force(rows)
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        gone = want.get((r.doc_id, texts[r.doc_id]), set())
        assert set(r.dropped) == gone
        assert r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in gone)
    assert sum(map(len, want.values())) > 100


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = lines.op3_line_dedup(spark, FOLDER).collect()
    texts, want = dict(docs), dropped_by_brute_force(docs)
    assert len(got) == len(docs)
    assert {(r.doc_id, texts[r.doc_id]): set(r.dropped) for r in got if r.dropped} == want


def test_a_large_group_of_near_lines(spark, monkeypatch):
    """Over a tile the group is joined line by line; the rule is the same as in small groups."""
    batches.session(spark)
    rng = random.Random(3)
    base = [f"word{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        words[rng.randrange(120)] = f"other{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = dropped_by_brute_force(rows)
    for tile in (2048, 20):
        monkeypatch.setattr(hamming, "TILE", tile)
        got = {(r.doc_id, rows[r.doc_id][1]): set(r.dropped) for r in lines.dedup_lines(df).collect() if r.dropped}
        assert got == want
    assert len(want) > 200


def test_edge_rows(spark):
    batches.session(spark)
    long = "\n".join(f"line number {i} of a very long text" for i in range(3000))
    rows = [
        (1, None), (2, ""), (3, "one two three\n\n«One», two: “THREE”!\n--\n--\nshort\nshort"), (4, long), (5, long + "\nshort"),
        (6, "own words only here"), (6, "own words only here"), (7, "first text of seven"), (7, "own words only here"),
        (None, "one two three"),
    ]
    df = spark.createDataFrame([(i, t, None if t is None else len(t), 0) for i, t in rows], "doc_id long, text string, n_chars long, dropped int")
    out = lines.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "n_chars", "dropped", "n_lines"}
    found = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    assert len(found) == len(rows)
    assert (0, "one two three", 13) in found  # a null id is the smallest
    assert (3, "\n--\n--\nshort", 12) in found  # repeats of one word go, lines without a word stay
    assert (1, None, None) in found and (2, "", 0) in found
    assert [t for i, t, _ in found if i == 5] == [""]
    assert [t for i, t, _ in found if i == 6] == ["own words only here"] * 2
    assert sorted(t for i, t, _ in found if i == 7) == ["", "first text of seven"]
    same = lines.without_repeats(spark, df.withColumn("n_lines", F.lit(-5)))
    assert same.columns == [*df.columns, "n_lines"] and {(r.n_lines, r.dropped) for r in same.collect()} == {(-5, 0)}


def test_empty_table(spark):
    batches.session(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0
    assert lines.dedup_lines(spark.createDataFrame([(1, "all lines differ here")], df.schema)).first().text == "all lines differ here"


def test_near_lines_are_found_without_their_edit_distance(monkeypatch):
    def counted(a, b, most):
        raise AssertionError("the words are enough here")

    monkeypatch.setattr(lines, "edit_distance", counted)
    words = [f"word{i}" for i in range(60)]
    changed = [*words[:5], "other", *words[6:50], "others", *words[51:]]
    for other in (changed, words[:30] + ["more", "words"] + words[30:], words[1:], words):
        assert lines.similar(" ".join(words), " ".join(other), 0.8)
        assert lines.similar(" ".join(other), " ".join(words), 0.8)


@settings(max_examples=400, deadline=None)
@given(st.text("ab ", max_size=14), st.text("ab ", max_size=14), st.integers(0, 8))
def test_few_edits_never_says_too_much(a, b, most):
    assert not lines.few_edits(a, b, most) or plain_distance(a, b) <= most


def test_only_clustered_lines_are_placed(spark, monkeypatch):
    """Lines that are like no other are not joined with clusters, shuffled or counted."""
    batches.session(spark)
    staged = {}
    plain = batches.stage

    def stage(df, label):
        staged[label] = plain(df, label)
        return staged[label]

    monkeypatch.setattr(batches, "stage", stage)
    rows = [(i, f"line {i} has words{i} of its{i} own{i}\ntwo one three\nshared") for i in range(50)]
    rows += [(60, "one two three"), (61, "three one two")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert staged["lines-fps"].count() > 50
    assert staged["lines-clusters"].count() < 10
    assert "lines-placed" not in staged
    want = dropped_by_brute_force(rows)
    assert {(r.doc_id, dict(rows)[r.doc_id]): set(r.dropped) for r in found if r.dropped} == want
