import math
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import batches, search

FOLDER = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(docs, items, top=50):
    """Sorted (item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, size = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, c in counted:
            m = 100 - 50 + 50 * c.total() * n_docs // size
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(scored[:top], 1)]
    return Counter(out)


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé9_-\x00\x7f\x80   \tİ"), max_size=30))
def test_terms(text):
    assert [t.decode() for t in search.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd", b"e1", b"f"]), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 5))
def test_bounds_are_never_below_the_score(docs, coordinates):
    queries = [[(b"a", 5), (b"b", 700)], [(b"dd", 90)], [(t, 3) for t in (b"a", b"c", b"e1", b"f")]]
    block = search.Block([0, 1, 2], queries, len(docs), sum(map(len, docs)), coordinates)
    counts, norms = [Counter(d) for d in docs], [search.length_norm(len(d), len(docs), sum(map(len, docs))) for d in docs]
    bounds = search.Sketches(block).bounds(counts, norms)
    for i, (c, m) in enumerate(zip(counts, norms)):
        for q, query in enumerate(queries):
            assert bounds[i, q] >= search.score(c, m, query)


def test_query_equals_brute_force_and_sql(spark):
    got = Counter(tuple(r) for r in search.op13_lexical_search(spark, FOLDER).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_force(rows(spark, "documents", "doc_id", "text"), rows(spark, "benchmark", "item_id", "text"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    assert got == Counter(con.sql(search.OP13_SQL).fetchall())


@pytest.mark.parametrize("block, step, coordinates", [(256, 512, 1 << 14), (2, 3, 7)])
def test_edge_rows(spark, monkeypatch, block, step, coordinates):
    """Nulls, ties, repeated rows, long texts, clashing names; blocks and steps change nothing."""
    monkeypatch.setattr(search, "BLOCK_ITEMS", block)
    batches.session(spark)
    pick = random.Random(3)
    words = ["tide", "mark", "Moon", "harbour", "sea", "ébb", "x9", "the"]
    docs = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 9)))) for i in range(120)]
    docs += [(None, "moon sea"), (None, "moon sea"), (7, None), (8, ""), (9, "--- !"), (500, "moon " * 60_000), (3, "tide mark"), (3, "tide mark")] + [(1000 + i, "harbour") for i in range(70)]
    items = [(1, "Tide mark"), (1, "moon"), (None, "harbour x9"), (4, None), (5, "unknown words"), (6, "THE the ébb"), (7, "harbour")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    got = search.search(d, i, coordinates=coordinates, step_docs=step).select("item.item_id", "rank", "doc_id", "score").collect()
    assert Counter(tuple(r) for r in got) == brute_force(docs, items)
    assert search.search(d.limit(0), i).count() == search.search(d, i.limit(0)).count() == 0
