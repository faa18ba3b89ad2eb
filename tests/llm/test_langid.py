import math
from collections import Counter
from zlib import crc32

import numpy as np

from tidemark.llm import batches, langid

FOLDER = "/root/testdata/sf0.01"
TEXTS = {"en": "the house and the garden of this town were with them", "de": "der Garten und das Haus nicht mit einer schönen Stadt", "fr": "la maison et le jardin de cette ville avec une été"}


def test_counts_equal_a_plain_count(monkeypatch):
    text = "Ab, ç9  d\n" * 7
    whole = langid.ngram_counts(text.encode())
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(letters.split()) + " "
    assert whole.sum() == sum(
        any(c != " " for c in padded[i : i + n]) for n in langid.WIDTHS for i in range(len(padded) - n + 1))
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 5)
    assert (langid.ngram_counts(text.encode()) == whole).all()
    assert langid.ngram_counts(b"12 !?") is None and langid.ngram_counts(b"") is None


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = langid.op10_language_id(spark, FOLDER).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.01


def plain_bins(text):
    """Counts of hashed n-grams, one n-gram at a time."""
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = Counter()
    for width in langid.WIDTHS:
        for i in range(len(padded) - width + 1):
            gram = padded[i : i + width]
            if gram.strip():
                mixed = width
                for c, mix in zip(gram, langid._MIX):
                    mixed = (mixed ^ (0 if c == " " else ord(c))) * int(mix) % 2**64
                found[mixed >> 52] += 1
    return found


def test_query_equals_a_plain_classifier(spark):
    """Frequencies over all labelled rows, and each text against every centroid, without matrices."""
    folder = FOLDER.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = langid.fit(langid.learnable(batches.table(spark, folder, "documents")))
    bins = {r.doc_id: plain_bins(r.text) for r in docs}
    learned = [bins[r.doc_id] for r in docs if r.lang is not None and crc32(str(r.doc_id).encode()) % 4 != 2 and bins[r.doc_id]]
    seen = Counter(b for found in learned for b in found)
    idf = [math.log((1 + len(learned)) / (1 + seen[b])) + 0.1 for b in range(langid.BINS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r.doc_id: r for r in langid.op10_language_id(spark, folder).collect()}
    assert set(got) == set(bins)
    centroids = model.centroids.astype(float).tolist()
    for i, found in bins.items():
        weights = {b: math.sqrt(n) * idf[b] for b, n in found.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * centre[b] for b, w in weights.items()) / norm for centre in centroids]
        best = max(cosines)
        assert abs(got[i].score - best) < 1e-4
        near = {lang for lang, c in zip(model.langs, cosines) if c > best - 1e-4}
        assert got[i].lang_pred in near
        lowest = model.lowest[cosines.index(best)]
        assert abs(best - lowest) < 1e-4 or got[i].rejected == (best < lowest)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    batches.session(spark)
    rows = [(i, TEXTS["en"], "xx" if crc32(str(i).encode()) % 4 == 2 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(langid.learnable(df)).langs) == {"en"}


def test_edge_rows(spark):
    batches.session(spark)
    rows = [(i, t + f" {'abc'[i % 3]}", lang) for i, (lang, t) in enumerate(list(TEXTS.items()) * 20)]
    odd = [(None, "zzqx " * 30000, None), (90, None, "en"), (91, "", None), (92, "12 ?!", "de"), (1, rows[1][1], "de"), (1, rows[1][1], "de")]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int")
    model = langid.fit(df.selectExpr("doc_id id", "text", "lang"))
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    assert all(r.lang_pred == r.lang for r in found if r.text and r.lang and r.doc_id != 92)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in found if r.doc_id in (90, 91, 92))
    assert [r.rejected for r in found if r.doc_id is None] == [True]
    kept = langid.keep_identified(spark, df)
    assert kept.columns == df.columns and kept.count() == len(rows) + 2


def test_empty_tables(spark):
    batches.session(spark)
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.fit(df.selectExpr("doc_id id", "text", "lang"))).count() == 0
    assert langid.keep_identified(spark, df).count() == 0
    unlabelled = spark.createDataFrame([(1, "the house", None)], df.schema)
    assert langid.identify(unlabelled, langid.fit(unlabelled.selectExpr("doc_id id", "text", "lang"))).first().lang_pred == "und"
    assert np.isfinite(langid.fit(unlabelled.selectExpr("doc_id id", "text", "lang")).idf).all()


def test_without_labels_nothing_goes(spark):
    batches.session(spark)
    rows = [(i, f"some words of text number {i}", None) for i in range(50)] + [(None, None, None), (51, "123", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.keep_identified(spark, df)
    assert kept.columns == df.columns and kept.count() == len(rows)
