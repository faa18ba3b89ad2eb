import random

import numpy as np
import pytest
import xxhash

from tests.llm import brute
from tidemark.llm import batches, minhash, simhash


def made_rows():
    """Texts with one to three changed places in groups, and a large group around one text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    bases = [[word() for _ in range(rng.randint(60, 300))] for _ in range(30)]
    rows = []
    for i in range(260):
        words = list(bases[0] if i % 4 == 0 else rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, " ".join(word() for _ in range(50))) for i in range(40)]


def kept_by_brute_force(rows):
    """Ids kept by comparing all pairs by their true similarity, and the number of similar pairs."""
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    similar = lambda a, b: len(a & b) / len(a | b) >= simhash.SIMILARITY
    found = brute.groups(sets, similar)
    return {rows[g][0] for g in found}


def test_recall_of_pairs():
    """One changed place of five-word shingles at a time, down to a similarity of 0.8."""
    rng = random.Random(4)
    found = tried = 0
    for n in range(500):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(90)], dtype=np.uint64))
        b = np.unique(np.concatenate([a[:80], np.array([rng.getrandbits(64) for _ in range(10)], dtype=np.uint64)]))
        assert minhash.jaccard(a, b) == 0.8
        tried, found = tried + 1, found + bool((minhash.bands(a) == minhash.bands(b)).any())
    assert found >= 0.99 * tried


@pytest.mark.parametrize("nodes", [1024, 8])
def test_edited_copies_equal_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(minhash, "TILE_NODES", nodes)
    batches.session(spark)
    rows = made_rows()
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = kept_by_brute_force(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert len(want) < len(rows) / 2


def test_one_changed_word_in_two_hundred_is_a_near_copy(spark):
    batches.session(spark)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[: 5 * i + 3] + ["other"] + words[5 * i + 4 :])) for i in range(30)]
    assert [r.doc_id for r in simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_a_repeated_id_keeps_its_unique_text(spark):
    batches.session(spark)
    a, b = "one text of several words here", "quite another text with its own words"
    df = spark.createDataFrame([(3, a), (7, a), (7, b), (8, b), (8, b), (9, None), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(spark, df).collect()), key=str)
    assert got == [(0, a), (3, a), (7, b), (9, None)]


def test_shingles_are_made_once(spark, monkeypatch):
    """Sets, bands and fingerprints of a text come from one pass over its shingles."""
    batches.session(spark)
    texts = ["", " ", "one two", " ".join(f"w{i % 40}" for i in range(700)), "a b c d e f g"]
    made = minhash.voted([simhash.hashes(simhash.shingles(t.encode(), 5)) for t in texts])
    assert made.tolist() == [simhash.fingerprint(t.encode(), 5) for t in texts]
    for t in texts:
        found = minhash.gram_set(simhash.shingles(t.encode(), 5))
        assert found.tolist() == sorted({xxhash.xxh64_intdigest(s) for s in simhash.shingles(t.encode(), 5)})
