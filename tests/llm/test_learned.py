"""Toxicity on a small corpus, and the pipeline's stages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.llm import toxicity


def corpus(n=500, seed=1):
    rnd = random.Random(seed)
    syllables = ["an", "the", "on", "re", "st", "nd", "ou", "ing", "er", "ti"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 3])))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(20, 90))]
        toxic = i % 6 == 0
        for _ in range(2 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(["moron", "idiot", "scumbag", "scummy"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_and_inserted_characters(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    truth = dict(labels)
    assert len(held) > 60 and sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    model = toxicity.train_by_contract(docs, marks)
    more = spark.createDataFrame([(1, "the idxiot and mo.ron here"), (2, "the ing and ou here"), (3, ""), (4, None), (5, "x" * 50_000)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(more, model).collect()}
    assert score[1] > 0.5 > max(score[i] for i in (2, 3, 4, 5)) and score[3] == score[4]


def test_one_class_gives_its_share(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()} == {0.0}
    assert toxicity.toxicity_report(docs.limit(0), marks.limit(0)).count() == 0


def test_kernel_is_symmetric_and_one_on_itself():
    words = ["idiot", "moron", "loweichen", "loweiung", "a"]
    near = toxicity.Landmarks(words).similar(words)
    assert near.diagonal() == pytest.approx(1, abs=1e-4) and abs(near - near.T).max() < 1e-4
    assert near[2, 3] > near[0, 1]


def plain_kernel(a, b):
    """The gapped-subsequence similarity of two words, by listing all subsequences."""

    def listed(word):
        c, out = ["<", *word, ">"], {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(i + 5, len(c))):
                    key = (c[i], c[j], c[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = listed(a), listed(b)
    norm = lambda v: sum(w * w for w in v.values()) ** 0.5
    return min(1, sum(w * y.get(s, 0) for s, w in x.items()) / (norm(x) * norm(y))) ** toxicity.POWER


def test_kernel_equals_plain_enumeration():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    marks = words[:20]
    got = toxicity.Landmarks(marks).similar(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            want = plain_kernel(w, m)
            assert got[i, j] == pytest.approx(want if want >= toxicity.FLOOR else 0, abs=1e-3) or abs(want - toxicity.FLOOR) < 1e-3


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [" ".join(w for _, t in corpus(40, seed)[0] for w in t.split()) for seed in range(3)]
    want = toxicity.Describer(["idiot", "moron", "ingthe"]).features(texts)
    monkeypatch.setattr(toxicity, "MEMO", 50)
    monkeypatch.setattr(toxicity, "ENTRIES", 40)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert (toxicity.Describer(["idiot", "moron", "ingthe"]).features(texts) == want).all() and want.any()


def test_repeated_ids_and_clashing_columns(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows] * 3, "doc_id long, text string, score double, predicted string")
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 360
    assert got.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        assert i == len(pipeline.STAGES) - 1 or docs.columns == columns
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    assert counts[0] > counts[1] == counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.where("NOT round_trip").count() == 0
