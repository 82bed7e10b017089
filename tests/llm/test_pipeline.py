"""The pipeline's stages against plain Python on a small table, and their odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
from test_learned import plain_kernel
from test_native import plain_seats, plain_targets
from test_pairs import plain_groups, roots

from weft.llm import line_dedup, mixing, toxicity
from weft.llm._vocab import default_path, read_ranks

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["an", "the", "re", "st", "ou", "ing", "er"]) for _ in range(rnd.choice([1, 2, 3])))
    passage = " ".join(word() for _ in range(12))
    rows, labels = [], []
    for i in range(90):
        lines = [" ".join(word() for _ in range(rnd.randrange(4, 25))) for _ in range(rnd.choice([1, 2, 4]))]
        if i % 5 == 0:  # a line that many share, with a word changed
            w = passage.split()
            w[rnd.randrange(12)] = word()
            lines.append(" ".join(w))
        toxic = i % 6 == 1
        text = "\n".join(lines)
        if toxic:
            text += " you moron and idiot"
        rows.append((i, text, "en", "abc"[i % 3] if i % 7 else None, len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(90, 100):  # near copies
        w = rows[i - 60][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(100, None, "en", "a", 0), (101, "", "en", "b", 0), (102, "the re " * 3000, "en", "c", 21000), (103, rows[2][1], "en", "b", 1)]
    return rows, labels


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def plain_lines(docs):
    """(doc_id, line) of the lines that go, by all pairs."""
    norm = lambda s: tuple(w for w in re.split(r"[\x00-\x20!-/:-@\[-`{-~]+", s.lower()) if w)
    lines = [(i, n, norm(s), sum(map(len, norm(s)))) for i, t in sorted(docs) for n, s in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5 or x[3] >= 12]
    number = {w: k for k, w in enumerate(sorted({w for x in lines for w in x[2]}))}
    coded = [np.array([number[w] for w in x[2]], np.uint64) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a][2] == lines[b][2] or (min(len(coded[a]), len(coded[b])) >= 5 and line_dedup.edit_alike(coded[a], coded[b]))]
    return {lines[i][:2] for i, root in roots(range(len(lines)), links).items() if i != root}


def plain_mix(docs):
    """How often each document is taken whole, blocks being single words."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    by: dict = {}
    for i, _, s in docs:
        by[s] = by.get(s, 0) + sizes[i]
    total = sum(by.values())
    seats = plain_seats(plain_targets(list(by.items())), total)
    out = {}
    for s, blocks in by.items():
        at, quota = 0, min(seats[s], 3 * blocks)
        for i in sorted((i for i, _, x in docs if x == s), key=lambda i: (hashlib.md5(f"{i}:7".encode()).hexdigest(), i)):
            place = ((min(at, blocks - 1) * mixing.STEP) % blocks + 7 % blocks) % blocks
            out[i] = quota // blocks + (place < quota % blocks) if sizes[i] else 0
            at += sizes[i]
    return out


def test_stages_equal_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train_by_contract(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kernel: dict = {}

    def likeness(word, mark):
        key = (word, mark)
        if key not in kernel:
            near = max((plain_kernel(p, mark) for p in toxicity.pieces(word)), default=0)
            kernel[key] = near if near >= toxicity.FLOOR else 0
        return kernel[key]

    def plain_score(text):
        words = toxicity.words_of(text or "")
        return model.score(np.array([[max((likeness(w, m) for w in words), default=0) for m in model.landmarks]]))[0]

    text = {r.doc_id: r.text for r in docs.collect()}
    (_, one), (_, two), (_, three), (_, four), (_, five) = pipeline.STAGES

    def stage(f, docs, i):
        f(spark, docs, folder).write.parquet(str(tmp_path / f"s{i}"))
        return spark.read.parquet(str(tmp_path / f"s{i}"))

    docs = stage(one, docs, 1)
    kept = {r.doc_id for r in docs.collect()}
    scores = {i: plain_score(t) for i, t in text.items()}
    assert {i for i, s in scores.items() if s < 0.499} <= kept <= {i for i, s in scores.items() if s < 0.501}
    assert 10 <= len(text) - len(kept) <= 25

    docs = stage(two, docs, 2)
    gone = plain_lines([(i, text[i]) for i in kept])
    want = {i: None if text[i] is None else "\n".join(s for n, s in enumerate(text[i].split("\n")) if (i, n) not in gone) for i in kept}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == want and len(gone) > 15

    source = {r.doc_id: r.source for r in docs.collect()}
    docs = stage(three, docs, 3)
    groups = plain_groups(sorted(want.items()), 5, 80)
    stays = {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in docs.collect()} == stays

    docs = stage(four, docs, 4)
    times = plain_mix([(i, want[i], source[i]) for i in stays])
    counts: dict = {}
    for r in docs.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for i, n in times.items() if n}

    docs = stage(five, docs, 5)
    import public_tokenizers

    ranks = {b: i for i, b in enumerate(read_ranks(default_path()))}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert list(r.token_ids) == plain.encode_ordinary(want[r.doc_id] or "") and r.round_trip


@pytest.mark.parametrize("index", range(5))
def test_every_stage_takes_empty_tables_nulls_and_more_columns(spark, folder, index):
    stage = pipeline.STAGES[index][1]
    more = SCHEMA + ", size long, score double, n_dropped long, component_id long, shard int"
    rows = [(i, t, None, s, None, 1, 1.0, 2, 3, 4) for i, t, s in [(1, None, None), (2, "", "a"), (3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (None, "six five four three two one", None), (4, "w " * 20_000, "b")]]
    docs = spark.createDataFrame(rows, more)
    assert stage(spark, docs.limit(0), folder).count() == 0
    got = stage(spark, docs, folder)
    if index < 4:
        assert got.columns == pipeline.COLUMNS
    assert got.count() <= 3 * len(rows) and got.where("doc_id = 4").count() >= 1


def test_stages_give_python_small_batches_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for said, want in (("10000", str(pipeline.BATCH_ROWS)), ("77", "77")):
            spark.conf.set(name, said)
            pipeline._small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
