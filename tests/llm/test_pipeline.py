import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_lines import dropped_by_brute_force
from tidemark.llm import batches, decontaminate, langid

FOLDER = "/root/testdata/sf0.001"


def leaks(text, items):
    words = decontaminate.words_of(text)
    for item in items:
        number = {w: n for n, w in enumerate(dict.fromkeys(item))}
        ids = np.array([number[w] for w in item])
        score, _ = decontaminate.smith_waterman(ids, np.array([number.get(w, -1) for w in words]))
        if score / len(ids) >= decontaminate.THRESHOLD:
            return True
    return False


def test_pipeline_equals_brute_force(spark):
    batches.session(spark)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    model = langid.fit(table.selectExpr("doc_id id", "text", "lang"))
    rejected = model.predict([t.encode() for t in docs.values()])[2]
    docs = {i: t for (i, t), gone in zip(docs.items(), rejected) if not gone}
    gone = dropped_by_brute_force(list(docs.items()))
    docs = {
        i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), ())) for i, t in docs.items()}
    near = brute.near_duplicates(list(docs.items()), width=5)
    docs = {i: t for i, t in docs.items() if near[i][1] == i}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not leaks(t, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()

    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.text for r in got} == docs
    for r in got:
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids
        assert r.round_trip and r.n_tokens == len(r.token_ids) and r.n_chars == len(r.text)


def test_stages_keep_the_columns_and_take_edge_rows(spark):
    batches.session(spark)
    long = "\n".join(f"line number {i} with words of its own, as {i * 7} shows" for i in range(2000))
    rows = [
        (1, None, "en", "s", None, 1), (2, "", None, "s", 0, 2), (3, "the house and the garden here", "en", None, 1, 3),
        (None, "a text without any number at all", None, "s", 2, 4), (5, long, "en", "s", 3, 5), (5, long, "en", "s", 3, 5), (6, long, "en", "s", 3, 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for docs in (df, df.where("score > 99")):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, batches.stage(stage(spark, docs, FOLDER), "test")
            assert docs.columns[: len(before)] == before or set(before) <= set(docs.columns), name
            if name != "tokens":
                assert docs.columns == before
        kept = docs.collect()
    assert not kept


def test_entry_registers_all():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
