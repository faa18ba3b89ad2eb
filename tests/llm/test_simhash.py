import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import batches, components, golay, hamming, simhash
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_golay_words_one_bit_apart_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    keys, is_set = golay.keys(words)
    assert set(is_set.sum(axis=1).tolist()) <= {1, 6}
    for bit in range(23):
        other, other_set = golay.keys(words ^ (1 << bit))
        assert all(
            set(a[s].tolist()) & set(b[t].tolist())
            for a, s, b, t in zip(keys, is_set, other, other_set)
        )


def test_fingerprints_two_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    rows, found = simhash.golay_keys(fps)
    mine = {i: set(found[rows == i].tolist()) for i in range(len(fps))}
    for i, fp in enumerate(fps):
        a, b = rng.choice(64, 2, replace=False)
        near = np.array([fp ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))], dtype=np.uint64)
        assert mine[i] & set(simhash.golay_keys(near)[1].tolist())


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming, "TILE", 16)  # so that large buckets are tiled here, too
    batches.session(spark)
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(rng.choice([0, 1, 2, 60])):
            flip = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(centre ^ flip)
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    want = brute.groups(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.fp % (1 << 64): r.group % (1 << 64) for r in hamming.groups(df, simhash.with_golay_keys, 2, "test").collect()}
    assert got == {fp: fps[i] for fp, i in zip(fps, want)}


def test_components_of_paths_and_structs(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (101, 100), (102, 102)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, "test").collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100}
    pairs = edges.select(F.struct("a", F.lit(0)).alias("a"), F.struct("b", F.lit(0)).alias("b"))
    assert {r.node.a: r.component.a for r in components.components(pairs, "test").collect()} == got
    assert components.components(edges.where("a < 0"), "test").count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = brute.near_duplicates([(d.doc_id, d.text) for d in docs])
    got = simhash.op1_simhash_near_dedup(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == want


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d " * 20000),
    (8, "a b c d " * 20000), (9, "é\x1cé x y z"), (9, "é\x1cé x y z"), (None, "one"), (None, None),
]


def test_edge_rows(spark):
    batches.session(spark)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in EDGES], "doc_id long, text string, fp string, component int")
    got = sorted((str(r.id), r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect())
    want = brute.near_duplicates([(i, t) for i, t in dict(EDGES).items() if i])
    assert got == sorted(
        (str(i), brute.fingerprint(t), want[i][1] if i else {"one": 4, None: 1}[t]) for i, t in EDGES)
    kept = simhash.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "9", "None", "None"]


def test_empty_table(spark):
    batches.session(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(spark, df).count() == 0


def test_wider_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), radius=3)


def test_crowded_buckets_meet_under_longer_keys(spark, monkeypatch):
    """Thousands of fingerprints around a few centres: groups as by brute force, links in proportion."""
    batches.session(spark)
    monkeypatch.setattr(hamming, "TILE", 16)
    rng = random.Random(12)
    for radius, keyed in ((2, simhash.with_golay_keys), (3, lambda fps: hamming.block_keys(fps, 3, 2))):
        fps = set()
        centres = [rng.getrandbits(64) for _ in range(3)]
        while len(fps) < 1500:
            fps.add(rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
        signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
        table = batches.stage(spark.createDataFrame([(x,) for x in signed], "fp long"), "test-fps")
        found = hamming.links(table, keyed, radius, "test")
        assert found.count() < 40 * len(fps)
        got = {r.fp: r.group for r in hamming.groups(table, keyed, radius, "test").collect()}
        a, b = hamming.spanning_links(np.array(sorted(fps), dtype=np.uint64), radius)
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            parent[root(x)] = root(y)
        want = {}
        for x in signed:
            want.setdefault(root(x % (1 << 64)), []).append(x)
        assert got == {x: min(some) for some in want.values() for x in some}
        assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= radius for r in found.collect())


def test_keep_one_links_by_fingerprints_and_by_shared_shingles(spark):
    """A text goes for two bits or less though its set of shingles is another, or for its set though its bits are others."""
    refrain = "we sing the same old words once more and " * 200
    words = [f"w{i}" for i in range(400)]
    edited = words[:200] + ["other"] + words[201:]
    rows = [
        (1, refrain + " ".join(f"a{i}" for i in range(40))), (2, refrain + " ".join(f"b{i}" for i in range(40))),
        (3, " ".join(words)), (4, " ".join(edited)), (5, "nothing like any of the others here")]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    bits = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    assert bits(1, 2) <= simhash.RADIUS and len(sets[1] & sets[2]) < 0.5 * len(sets[1] | sets[2])
    assert bits(3, 4) > simhash.RADIUS
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def test_short_runs_are_searched_at_once():
    """Runs of two to FEW rows go to one call a batch; their links connect what plain comparison connects."""
    rng = np.random.default_rng(7)
    lengths = rng.integers(2, hamming.FEW + 1, 200)
    keys = np.repeat(np.arange(202), np.concatenate([[1], lengths, [1]]))
    fps = np.concatenate([
        base ^ np.left_shift(np.uint64(1), rng.integers(0, 64, n, dtype=np.uint64)) ^ np.left_shift(np.uint64(1), rng.integers(0, 9, n, dtype=np.uint64))
        for base, n in zip(rng.integers(0, 1 << 63, 202, dtype=np.uint64), [1, *lengths.tolist(), 1])])
    calls = []

    def few(batch, starts, lengths):
        calls.append(len(starts))
        return hamming.links_in_runs(batch.column(1).to_numpy(), starts, lengths, 3)

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*found)], ["a", "b"])

    def alone(rows):
        raise AssertionError("a short run was searched on its own")

    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["key", "fp"])
    (found,) = hamming.search_runs(alone, emit, None, few)(iter([batch]))
    assert calls == [200]
    links = list(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    want = [frozenset(g) for k in range(1, 201) for g in _connected(set(fps[keys == k].tolist()), 3)]
    assert sorted(map(sorted, _joined(links))) == sorted(sorted(g) for g in want if len(g) > 1)
    assert len(links) < 3 * len(fps)


def _connected(rest, radius):
    while rest:
        group, queue = set(), [rest.pop()]
        while queue:
            at = queue.pop()
            group.add(at)
            near = {x for x in rest if (x ^ at).bit_count() <= radius}
            rest -= near
            queue += near
        yield group


def _joined(links):
    groups = {}
    for a, b in links:
        if a != b:
            both = groups.get(a, {a}) | groups.get(b, {b})
            groups |= dict.fromkeys(both, frozenset(both))
    return set(groups.values())
