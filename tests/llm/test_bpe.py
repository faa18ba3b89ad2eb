import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import batches, bpe

FOLDER = "/root/testdata/sf0.001"
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.read_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the ", "hen", "n't", END, "  ", "\n", "é", "漢", "9", "ab", "!!", "\u0085"])).map("".join))
def test_ids_equal_the_library(library, own, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_block_of_code_points(library, own):
    for low in [*range(0, 0xD800, 64), *range(0xE000, 0x30000, 64)]:
        chars = [chr(i) for i in range(low, low + 64)]
        text = "x".join(chars) + " " + " ".join(chars) + "".join(f"1{c}  a" for c in chars)
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d.doc_id] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
    got = bpe.op2_bpe_encoding(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_edge_rows(spark, library):
    batches.session(spark)
    rows = [(1, None, 7), (2, "", 7), (None, "ab" * 20000, 7), (3, f"a{END}b", 7), (3, f"a{END}b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    coded = bpe.encode(df)
    assert coded.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    found = bpe.decode(coded).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded) == (len(r.token_ids), r.text or "")
    assert bpe.encode(df.where("doc_id > 9")).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).first().decoded == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=20) | st.lists(st.sampled_from(["the ", "'s", "'re", "'ll", "'v", "hen", END, "  ", "\n", "é", "漢", "9", "'", "\u0085", " "])).map("".join)))
def test_many_texts_at_once_equal_the_library(library, own, texts):
    got = own.encode_all(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.decode_all(got) == [t.encode() for t in texts]


def test_a_piece_is_looked_up_once_for_many_texts(own, monkeypatch):
    looked = []
    monkeypatch.setattr(own, "new", {})
    monkeypatch.setattr(own, "old", {})
    monkeypatch.setattr(own, "_missing", lambda piece: looked.append(piece) or own.merge(piece.encode()))
    texts = ["so much of so much", "so much of it", END, "", "x" * 3000] * 40
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 1 << 20)
    got = own.encode_all(texts)
    assert sorted(looked) == sorted({"so", " so", " much", " of", " it", "x" * 3000})
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 50)
    assert [x.tolist() for x in own.encode_all(texts)] == [x.tolist() for x in got]


def test_every_code_point_is_cut_like_the_pattern(own):
    import numpy as np

    chars = [chr(c) for c in [*range(0, 0x3100), *range(0xFE00, 0x10000, 7), *range(0x10000, 0x20000, 31)]]
    text = "".join(f"{c}a{c}{c} {c}'{c}1 " for c in chars)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    fresh = np.zeros(len(points), dtype=bool)
    fresh[0] = True
    starts = [*np.flatnonzero(bpe.piece_starts(points, fresh)).tolist(), len(text)]
    assert [text[a:b] for a, b in zip(starts, starts[1:])] == own.pieces(text)


def test_short_pieces_merge_as_by_the_queue(own):
    words = ["the", " thenre", "aaaaaaaa", "abcabcabcabc", " ", "é漢", "e", " antidisestablish"]
    assert [own.merge_short(w.encode()) for w in words] == [own.merge(w.encode()) for w in words]
