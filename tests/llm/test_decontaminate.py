import random

import numpy as np
import pytest

from tidemark.llm import batches, decontaminate

FOLDER = "/root/testdata/sf0.001"


def plain_score(a, b):
    """Best local alignment by the textbook table."""
    m = decontaminate
    table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(
                0.0, table[i - 1][j - 1] + (m.MATCH if x == y else m.MISMATCH), table[i - 1][j] - m.GAP, table[i][j - 1] - m.GAP)
    return max(map(max, table))


def test_alignment_equals_the_textbook_table():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 20))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 40))]
        assert decontaminate.smith_waterman(np.array(a), np.array(b, dtype=int))[0] == pytest.approx(plain_score(a, b))


def edited(words, rng, share):
    return [w if rng.random() > share else "changed" + str(rng.randrange(99)) for w in words]


def test_planted_passages(spark):
    batches.session(spark)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") * rng.randint(1, 4)
    items = [(i, [word() for _ in range(rng.randint(15, 60))]) for i in range(30)]
    docs, want = [], {}
    for i in range(300):
        words = [word() for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            # the first item is in a third of the planted documents, edited or not
            item_id, item = items[0] if i % 9 == 0 else items[i % 30]
            at = rng.randint(0, len(words))
            words[at:at] = edited(item, rng, (0, 0.1, 0.2)[i // 3 % 3])
            want[i] = item_id
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {r.doc_id: [h.item_id for h in r.hits] for r in found.collect() if r.hits}
    missed = [i for i in want if want[i] not in got.get(i, [])]
    assert len(missed) <= 0.03 * len(want)
    assert set(got) <= set(want)


def test_bound_never_hides_a_match():
    rng = random.Random(8)
    hidden = matches = 0
    for _ in range(3000):
        item = np.array([rng.randrange(12) for _ in range(rng.randint(3, 14))])
        passage = [rng.randrange(12) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(passage))
            passage[at:at] = [w for x in item for w in ([x] + [99] * (rng.random() < 0.3))[rng.random() < 0.2 :]]
        passage = np.array(passage, dtype=int)
        match = decontaminate.smith_waterman(item, passage)[0] / len(item) >= decontaminate.THRESHOLD
        may = decontaminate.may_align(item, passage)
        assert may or not match
        hidden, matches = hidden + (not may), matches + match
    assert hidden > 100 and matches > 100


def test_edited_and_partial_copies_that_are_spread(spark):
    """A count of documents says nothing: thousands may hold the same edited passage."""
    batches.session(spark)
    items = {1: [f"a{i}" for i in range(60)], 2: [f"b{i}" for i in range(40)]}
    edited_copy = [w if i % 9 != 4 else "other" for i, w in enumerate(items[1])]  # 7 of 60 words
    rows = [(i, f"own{i} " + " ".join(edited_copy) + f" end{i}") for i in range(3000)]
    rows += [(3000 + i, f"own{i} " + " ".join(items[2][:25])) for i in range(100)]
    rows += [(4000 + i, f"words of {i} that no item has") for i in range(50)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {r.doc_id: [h.item_id for h in r.hits] for r in found.collect()}
    assert got == {i: [1] if i < 3000 else [2] if i < 4000 else [] for i, _ in rows}


def test_query_equals_full_alignment(spark):
    """Whatever a full alignment finds, the seeds find."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in decontaminate.op8_benchmark_decontamination(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words = decontaminate.words_of(text)
        want = []
        for k, item in items.items():
            number = {w: n for n, w in enumerate(dict.fromkeys(decontaminate.words_of(item)))}
            ids = np.array([number[w] for w in decontaminate.words_of(item)])
            score, _ = decontaminate.smith_waterman(ids, np.array([number.get(w, -1) for w in words]))
            if score / len(ids) >= decontaminate.THRESHOLD:
                want.append(k)
        assert sorted(want) == got[i].item_ids
        assert got[i].contaminated == bool(want)
    assert any(r.contaminated for r in got.values())


def test_edge_rows_and_blocks(spark, monkeypatch):
    batches.session(spark)
    passage = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, None), (2, ""), (3, f"Start. {passage.upper()}! End"), (3, passage), (None, "x " * 50000 + passage), (4, "two words")]
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, "two words"), (None, "x x x x x"), (10, "some other passage that is not there")], "item_id long, text string")
    for most in (20000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        found = decontaminate.find_leaks(df, bench)
        assert found.columns == df.columns
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            want = {7} if r.text and "fox" in r.text.lower() else {9} if r.doc_id == 4 else set()
            assert {h.item_id for h in r.hits} == want | ({None} if r.doc_id is None else set())
            assert len(r.hits) == len(want) + (r.doc_id is None)
        assert all(h.score == 1 and h.end_word - h.first_word == 10 for r in got for h in r.hits if h.item_id == 7)
    assert [h.first_word for r in got if r.doc_id is None for h in r.hits if h.item_id == 7] == [50000]
    kept = decontaminate.without_leaks(spark, df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert decontaminate.find_leaks(df, bench.where("item_id > 99")).count() == len(rows)
    assert decontaminate.find_leaks(df.where("doc_id > 9"), bench).count() == 0


def test_texts_that_share_an_id_and_short_items(spark):
    batches.session(spark)
    one, two = "the first text of this item has these words", "another text with the same id and other words"
    bench = spark.createDataFrame([(1, one), (1, two), (2, "Yes"), (3, "no way"), (4, "...")], "item_id long, text string")
    rows = [(1, f"a copy: {one}"), (2, f"a copy: {two}"), (3, "They said yes and no way out"), (4, "Q: so?\n* YES!\nno way\nyes"), (5, "...")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {r.doc_id: [(h.item_id, h.first_word, h.end_word) for h in r.hits] for r in found.collect()}
    assert got == {1: [(1, 2, 11)], 2: [(1, 2, 11)], 3: [], 4: [(2, 2, 3), (3, 3, 5)], 5: []}
