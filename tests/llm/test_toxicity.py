import math
import random
from zlib import crc32

import pytest
import zstandard

from tidemark.llm import batches, toxicity

FOLDER = "/root/testdata/sf0.1"


def made(n, rng):
    syllables = ["tha", "ren", "ous", "tion", "eal", "min", "dor", "sel", "vek", "lu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["grumpf", "zwackel", "Blorbag", "quixnat"])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(1500, random.Random(8))


def test_held_out_accuracy(spark, rows):
    batches.session(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs, labels))).collect()}
    assert len(got) == len(rows)
    held = [(got[i].predicted, y) for i, _, y in rows if crc32(str(i).encode()) % 3 == 1]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.9
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_labels_of_the_held_out_fold_are_not_learned(spark, rows):
    batches.session(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if crc32(str(i).encode()) % 3 == 1 else y
    first, second = (
        toxicity.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        for labels in ([(i, y) for i, _, y in rows], [(i, flip(i, y)) for i, _, y in rows])
    )
    assert sorted(first) == sorted(second)


def test_scores_equal_a_plain_scan(rows):
    """Windows that share bytes with toxic stretches, found by substrings, and the curve by hand."""
    m = toxicity
    model = m.fit([(i, t.encode(), y) for i, t, y in rows])
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=17, search_log=8, min_match=m.MATCH, target_length=128,
        strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(content):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        one = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)
        return lambda window: len(one.compress(window))

    ordinary, toxic = sizes(model.ordinary + bytes(len(model.toxic))), sizes(model.ordinary + model.toxic)
    some = [t for _, t, y in rows if y][:60] + [t for _, t, y in rows if not y][:60] + ["", "x", "grumpf"]
    found = 0
    for text, score in zip(some, model.scores([t.encode() for t in some])):
        flat = (" " + " ".join(text.lower().split()) + " ").encode()
        starts = range(0, max(1, len(flat) - m.WINDOW + m.STEP), m.STEP)
        windows = [flat[i : i + m.WINDOW] for i in starts]
        saved = [ordinary(w) - toxic(w) if any(w[i : i + m.MATCH] in model.toxic for i in range(len(w) - m.MATCH + 1)) else 0 for w in windows]
        values = []
        for least, usual in zip(m.SAVINGS, model.usual):
            n, usual = sum(s >= least for s in saved), len(saved) * usual
            values.append(math.sqrt(min(200, n * math.log(n / usual) - (n - usual))) if n > usual else 0.0)
        values += [math.sqrt(sum(s >= least for s in saved) / len(saved)) for least in m.SAVINGS]
        values.append(min(12, max(*saved, 0)))
        z = model.weights[-1] + sum(w * (v - c) / d for w, v, c, d in zip(model.weights, values, model.centre, model.scale))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9), text
        found += score >= m.THRESHOLD
    assert 50 <= found <= 65


def test_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = toxicity.op6_toxicity(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.5
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.02


def test_edge_rows(spark, rows):
    batches.session(spark)
    model = toxicity.fit([(i, t.encode(), y) for i, t, y in rows])
    odd = [(1, None), (2, ""), (3, "  \n"), (None, "tha ren ous " * 20000), (None, "grumpf zwackel blorbag grumpf"), (4, rows[0][1]), (4, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, score string")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(odd)
    assert all(r.predicted == 0 for r in got if not (r.text or "").strip())
    assert [r.predicted for r in got if r.text and "grumpf" in r.text and len(r.text) < 40] == [1]
    assert toxicity.score(df.where("doc_id > 9"), model).count() == 0


def test_too_few_labels_give_one_score(spark, rows):
    batches.session(spark)
    docs = spark.createDataFrame([r[:2] for r in rows[:10]], "doc_id long, text string")
    for labels in ([], [(1, 1), (None, 1), (2, None), (1, 0)]):
        sample = toxicity.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, toxicity.fit(sample)).collect()} <= {0.0, 0.5}
