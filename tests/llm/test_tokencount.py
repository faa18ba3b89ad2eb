import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import batches, tokencount

FOLDER = "/root/testdata/sf0.001"


def plain(ids, separator):
    out, n = [], 0
    for i in ids:
        if i == separator:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


def test_counts_equal_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "SEGMENT_BLOCKS", 3)
    batches.session(spark)
    rng = random.Random(9)
    rows, want = [], {}
    for file in range(12):
        share = rng.choice([0, 0.01, 0.2, 0.9, 1])
        ids = [7 if rng.random() < share else rng.randrange(8, 60000) for _ in range(rng.choice([0, 1, 4, 333, 1000]))]
        step = rng.choice([1, 4, 16])
        rows += [(file, n, np.array(ids[i : i + step], "<u2").tobytes()) for n, i in enumerate(range(0, len(ids), step))]
        want |= {(file, n): x for n, x in enumerate(plain(ids, 7))}
    rows += [(0, 10000, None), (0, 10001, b"")]
    rng.shuffle(rows)
    got = tokencount.count(spark.createDataFrame(rows, "file long, block long, data binary"), 7).collect()
    assert len(got) == len(want)
    assert {(r.file, r.number): (r.n_tokens, r.complete) for r in got} == want


@pytest.mark.parametrize("stores", [("file",), ()])
def test_files_on_disk(spark, tmp_path, monkeypatch, stores):
    monkeypatch.setattr(tokencount, "SEEKABLE", stores or ("none",))
    monkeypatch.setattr(tokencount, "RANGE_BLOCKS", 3)
    rng = random.Random(3)
    want = {}
    for name, n in (("a 1.bin", 9), ("b.bin", 0), ("c%20.bin", 1001), ("d.bin", 600)):
        ids = [9 if rng.random() < 0.2 else rng.randrange(10, 70000) for _ in range(n)]
        np.array(ids, "<u4").tofile(tmp_path / name)
        want |= {(name, n): x for n, x in enumerate(plain(ids, 9))}
    for more in ({}, {"opener": lambda path: open(path.removeprefix("file:"), "rb")}):
        blocks = tokencount.read_files(batches.session(spark), str(tmp_path), 2, "<u4", **more)
        found = blocks.collect()
        assert len(found) == 5 + 501 + 300 and all(len(r.data) <= 8 for r in found)
        got = {(r.file.rsplit("/", 1)[1], r.number): (r.n_tokens, r.complete) for r in tokencount.count(blocks, 9, "<u4").collect()}
        assert got == want


def test_query_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_TOKENS", 1 << 10)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = tokencount.op7_token_counts(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.n_tokens for r in got} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


def test_edge_rows(spark):
    batches.session(spark)
    rows = [(1, None), (2, ""), (None, "one two"), (3, "<|endoftext|> x"), (3, "<|endoftext|> x"), (4, "word " * 50000)]
    files = tokencount.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, file int"), block_tokens=8)
    got = tokencount.count(files.where("data IS NOT NULL")).collect()
    assert all(r.complete for r in got)
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 8, 8, 50001]
    empty = tokencount.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert tokencount.count(empty.where("data IS NOT NULL")).count() == 0
