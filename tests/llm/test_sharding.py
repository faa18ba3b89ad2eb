import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import batches, sharding

FOLDER = "/root/testdata/sf0.01"


def held(rows, shards=sharding.SHARDS):
    """Counts at most one apart, slots without a gap."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


def test_fisher_yates_orders_are_alike_likely():
    seen = Counter(tuple(sharding.fisher_yates(4, seed, 3)) for seed in range(24_000))
    assert len(seen) == 24
    assert sum((n - 1000) ** 2 / 1000 for n in seen.values()) < 60  # 23 degrees of freedom
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = sharding.op12_sharding(spark, FOLDER).collect()
    held(got)
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 50_000])
def test_order(spark, monkeypatch, bucket_bytes):
    """The same order again, another one for another seed, and no trace of the old one."""
    monkeypatch.setattr(sharding, "MOST_TASKS", 5)
    batches.session(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")

    def order(seed, shards=4):
        rows = sharding.shuffle(docs, shards, seed, stored=True, bucket_bytes=bucket_bytes).collect()
        held(rows, shards)
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]

    first, again, other = order(1), order(1), order(2)
    assert first == again != other
    n = len(first)
    assert abs(np.corrcoef(first, range(n))[0, 1]) < 4 / n**0.5
    assert abs(np.corrcoef(first, other)[0, 1]) < 4 / n**0.5
    neighbours = sum(b - a == 1 for a, b in zip(first, first[1:]))
    assert neighbours < 10


def test_edge_rows(spark):
    """Nulls, copies of a row, long texts, clashing names; copies are dealt to many buckets."""
    batches.session(spark)
    rows = [(None, None, 7, 1)] * 300 + [(5, "", 8, 2)] * 100 + [(i, "x" * (i * 40), 9, 3) for i in range(200)] + [(1, "é" * 400_000, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard int, extra int")
    out = sharding.shuffle(df, 7, bucket_bytes=20_000)
    assert out.columns == ["doc_id", "text", "extra", "shard", "slot"]
    got = out.collect()
    held(got, 7)
    assert Counter((r.doc_id, r.text, r.extra) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    copies = Counter(r.shard for r in got if r.doc_id is None)
    assert len(copies) == 7 and max(copies.values()) < 75
    assert sharding.shuffle(df.limit(0), 7).count() == 0
    assert Counter(r.shard for r in sharding.shuffle(df.limit(3), 7).collect()).most_common(1)[0][1] == 1


def test_files_are_in_slot_order(spark):
    batches.session(spark)
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('w', 50) AS text")
    out = sharding.shuffle(df, 3, bucket_bytes=40_000)
    for file in out.inputFiles():
        slots = [r.slot for r in spark.read.parquet(file).select("slot").collect()]
        assert slots == sorted(slots)
