"""Jaccard groups, line dedup, vectors and shards against brute force."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import _components, _groups, _shared, embedding_dedup, jaccard_join, line_dedup, sharding
from weft.llm._words import slabs


def roots(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def plain_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def copies(seed, sizes, families):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, t) for i, t in enumerate([None, "", " \n ", "a", "A b", "a B", "a b c d", "a b c d e"])]
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice(sizes))]
        for _ in range(rnd.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, len(base) // 40])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)]
            docs.append((len(docs), rnd.choice([" ", "\n", "\t"]).join(w)))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (1, 85), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, k, percent):
    docs = copies(k, [5, 8, 10, 12, 20, 40, 100, 300], 40)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, rep int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, k, percent).collect()}
    assert got == plain_groups(docs, k, percent)


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_report(docs).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (7, 3)]
    assert jaccard_join.jaccard_report(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one_per_group(docs.dropDuplicates()).select("doc_id").orderBy("doc_id").collect()[1][0] == 3


def test_allowances_add_up_and_avoid_short_segments():
    for counts, need, deletions in (([5, 1, 4, 0], 2, False), ([6, 0, 0], 2, True), ([0, 0], 1, True)):
        v = jaccard_join.allowances(np.array(counts), need, deletions)
        assert v.sum() == need and v.max() <= 2
    assert jaccard_join.allowances(np.array([5, 1, 4, 0]), 2, False).tolist() == [1, 0, 1, 0]


def test_components_equal_plain_union(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(1, 1)]
    got = {r.id: r.component for r in _components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {i: c for i, c in roots({x for e in edges for x in e}, edges).items() if i != c}


def test_edit_similarity_equals_plain_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd, pairs, want = random.Random(3), [], []
    for _ in range(1500):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(14))]
        b = list(a)
        for _ in range(rnd.randrange(4)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(6)) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        want.append(distance(a, b) <= max(len(a), len(b)) * 20 // 100)
        assert line_dedup.edit_alike(*pairs[-1]) == want[-1]
    for a, b in pairs[:40]:  # more words than an integer has bits
        pairs.append((np.tile(a, 9), np.tile(b, 9)))
        want.append(distance(pairs[-1][0].tolist(), pairs[-1][1].tolist()) <= max(len(a), len(b)) * 9 * 20 // 100)
    assert [line_dedup.edit_alike(a, b) for a, b in pairs] == want
    assert line_dedup.edits_alike(*zip(*pairs, strict=True)).tolist() == want


def test_tiles_compare_pairs_of_many_rows_at_once():
    rnd, calls = np.random.default_rng(4), []
    values = [rnd.integers(0, 1 << 32, 12, np.uint32) for _ in range(60)]
    for v in values[:60]:
        for _ in range(5):
            values.append(v.copy())
            values[-1][rnd.choice(12, 2, replace=False)] = rnd.integers(0, 1 << 32, 2, np.uint32)

    def many(one, two):
        calls.append(len(one))
        return line_dedup.edits_alike(one, two)

    alike = _groups.Alike(many, may=lambda v: line_dedup.parities_may(v, 80), kind=np.uint32)
    n = len(values)
    found = _groups._linked(alike, values, np.arange(n), ~np.eye(n, dtype=bool))
    want = [(a, b) for a in range(n) for b in range(a) if line_dedup.edit_alike(values[a], values[b])]
    assert roots(range(n), found.tolist()) == roots(range(n), want)
    assert len(calls) < n / 10


def test_what_was_shuffled_for_a_checkpoint_is_deleted_at_once(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    dealt = spark.range(10_000).repartition(4, "id")
    done = _shared.cut(dealt)
    for _ in range(20):  # deletion isn't waited for
        if shuffled() - before:
            time.sleep(0.1)
    assert not shuffled() - before
    assert done.count() == dealt.count() == 10_000


def test_lines_belong_to_their_texts():
    texts = ["a b\nc", "", "x\n", "\n\n", "q", None, "\n", "z z\n\ny"]
    for _, data, offsets in slabs(pa.array(texts)):
        lines = line_dedup.Lines(data, offsets)
        got = defaultdict(list)
        for t, n, c in zip(lines.text.tolist(), lines.number.tolist(), lines.counts.tolist(), strict=True):
            got[t].append((n, c))
        assert got == {i: [(j, len(s.split())) for j, s in enumerate((t or "").split("\n"))] for i, t in enumerate(texts)}


def test_repeated_lines_go(spark):
    long = "this is a longer line whose words are all found again but for one"
    rows = [(1, "One two three four five six.\nshort line"), (2, "one TWO three, four five six\nother words are in this one line"), (3, None), (4, ""), (None, "one two three four five six"), (5, "short line\none two three four five six\none two three four five six"), (6, long), (7, long + " word")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("other words are in this one line", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[None] == (rows[4][1], 0)
    assert got[5] == ("short line", 2) and got[6] == (long, 0)
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(df).collect()}
    whole = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in whole])
    near = x @ x.T >= 0.9
    ids = [i for i, _ in whole]
    want = roots([i for i, _ in rows], [(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b])
    links = dict(zip(ids, (near.sum(1) - 1).tolist(), strict=True))
    found = sum(n for n, _ in got.values())
    assert found >= 0.98 * sum(links.values()) and all(n <= links.get(i, 0) for i, (n, _) in got.items())
    assert sum(got[i][1] == want[i] for i in want) >= 0.98 * len(want)
    assert got[2000] == (0, 2000) and got[2003] == (0, 2003)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 1000, 3000)
    totals = np.bincount(sharding.differencing(sizes, 40), sizes, 40)
    assert totals.max() - totals.min() <= 1000 and totals.sum() == sizes.sum()
    assert sharding.differencing(np.array([5, 4, 3, 3, 3]), 2).tolist().count(0) in (2, 3)


def plain_differencing(sizes, parts):
    """Totals of the parts by combining the two widest lists of totals until one is left."""
    lists = [([x] + [0] * (parts - 1), i) for i, x in enumerate(sizes)]
    made = len(sizes)
    while len(lists) > 1:
        lists.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _) = lists[:2]
        lists[:2] = [(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), made)]
        made += 1
    return lists[0][0]


def test_differencing_equals_a_plain_one():
    rnd = random.Random(8)
    for parts in (2, 3, 7, 40):
        sizes = sorted((rnd.choice([rnd.randrange(1, 50), rnd.randrange(1, 5000)]) for _ in range(90)), reverse=True)
        part = sharding.differencing(np.array(sizes), parts)
        totals = np.bincount(part, sizes, parts).astype(int)
        assert sorted(totals.tolist(), reverse=True) == plain_differencing(sizes, parts)


def test_shards_are_equal_in_one_piece_and_by_a_tree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.choice([rnd.randrange(5, 200), rnd.randrange(5, 3000)]) + str(i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for root in (1 << 16, 400):
        monkeypatch.setattr(sharding, "ROOT", root)
        monkeypatch.setattr(sharding, "BUCKET", 500)
        monkeypatch.setattr(sharding, "PARTS", 40)
        totals = sharding.shard_report(docs).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
        assert len(totals) == 40 and totals.max() - totals.min() <= (2 if root > 400 else 0.01 * totals.mean())


def test_shards_keep_groups_and_count_slots(spark, monkeypatch):
    for name, small in (("ROOT", 60), ("BUCKET", 50), ("PARTS", 8)):  # several levels of the tree
        monkeypatch.setattr(sharding, name, small)
    rows = [(i, None if i % 97 == 0 else f"text {i % 250} " * (i % 23)) for i in range(900)] + [(1, "same")] * 3
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and got.shard.between(0, 39).all()
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    totals = got.groupby("shard")["size"].sum()
    assert totals.max() <= 1.6 * totals.mean()
    assert sharding.shard_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_of_one_hot_group(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = sharding.assign_shards(docs, shards=4).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == 4 and max(r.s for r in got) <= 0.45 * sum(r.s for r in got)


@pytest.mark.parametrize("many", [2, 64])
def test_fuzzy_lines_equal_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(line_dedup, "MANY", many)
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    lines = []
    for n in [5, 6, 9, 10, 14, 20, 33, 50, 65, 80, 100, 130, 160, 260] * 5:
        base = [rnd.choice(vocabulary) for _ in range(n)]
        lines.append(base)
        for share in (0.03, 0.1, 0.19, 0.2, 0.25):
            w = list(base)
            for _ in range(max(1, int(share * n))):
                at = rnd.randrange(len(w))
                w[at : at + rnd.choice([0, 1, 1])] = [rnd.choice(vocabulary)] * rnd.choice([0, 1, 1, 1])
            if len(w) >= 5:
                lines.append(w)
    rnd.shuffle(lines)
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = [np.array([number[w] for w in x], np.uint64) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if line_dedup.edit_alike(coded[a], coded[b])]
    assert len(links) > 300
    want = [i for i, root in roots(range(len(lines)), links).items() if i != root]
    docs = spark.createDataFrame([(i // 3, "\n".join(" ".join(x) for x in lines[i : i + 3])) for i in range(0, len(lines), 3)], "doc_id long, text string").repartition(3)
    got = sorted(3 * r.doc_id + r.line for r in line_dedup.repeated_lines(docs).collect())
    assert got == sorted(want)


def test_both_fuzzy_lines_are_seen(spark):
    long = "this is a longer line whose words are all found again but for one"
    docs = spark.createDataFrame([(6, long), (7, long + " word")], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()] == [(6, long, 0), (7, "", 1)]


@pytest.mark.parametrize("many", [2, 8, 1000])
def test_lines_of_a_key_hang_together_as_all_pairs_do(many):
    rng = np.random.default_rng(5)
    rows = np.zeros(400, line_dedup._KEY)
    rows["key"], rows["n"], rows["name"] = rng.integers(0, 9, 400), rng.choice([8, 10, 12, 40, line_dedup.MOST], 400, p=[0.3, 0.3, 0.3, 0.09, 0.01]), rng.permutation(400)
    rows["at"] = np.where(rng.random(400) < 0.05, line_dedup.MOST, rng.integers(0, 8, 400))
    a, b = np.nonzero((rows["key"][:, None] == rows["key"][None, :]) & (np.arange(400)[:, None] < np.arange(400)[None, :]))
    near = line_dedup._close(rows, a, b, 80)
    want = {tuple(sorted(x)) for x in np.stack([rows["name"][a], rows["name"][b]], 1)[near].tolist()}
    assert (line_dedup.unpacked(line_dedup.packed(rows)) == rows).all()
    pairs, groups = line_dedup.candidates(rows.copy(), 80, many)
    assert {tuple(x) for x in pairs.tolist()} <= want and (many < 1000 or (len(pairs) == len(want) and not len(groups)))
    assert roots(range(400), [*pairs.tolist(), *groups.tolist()]) == roots(range(400), want)


def test_parities_never_part_alike_lines():
    rnd = random.Random(6)
    for _ in range(500):
        a = np.array([rnd.getrandbits(32) for _ in range(rnd.choice([5, 15, 16, 17, 33, 70]))], np.uint32)
        b = list(a)
        for _ in range(rnd.randrange(1 + len(a) // 4)):
            b.insert(rnd.randrange(len(b) + 1), rnd.getrandbits(32)) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        b = np.array(b, np.uint32)
        if line_dedup.edit_alike(a, b):
            assert line_dedup.parities_alike(line_dedup.parity(a), line_dedup.parity(b), len(a), len(b), 80)
            assert line_dedup.parities_may([a, b], 80)(0).all()


def test_parities_of_many_pairs_equal_those_of_one():
    rng = np.random.default_rng(7)
    one = [rng.integers(0, 1 << 32, int(n), np.uint32) for n in rng.choice([5, 16, 17, 33, 70, 300], 400)]
    two = [v[: len(v) - int(rng.integers(0, 1 + len(v) // 4))] for v in one]
    n, m = (np.array([len(v) for v in x]) for x in (one, two))
    a, b = ([line_dedup.parity(v) for v in x] for x in (one, two))
    want = [line_dedup.parities_alike(*x, 80) for x in zip(a, b, n.tolist(), m.tolist(), strict=True)]
    found = line_dedup.parities_alike_all(pa.array(a, pa.binary())[3:], pa.array(b, pa.binary())[3:], n[3:], m[3:], 80)
    assert 0 < sum(want) < len(want) and found.tolist() == want[3:]


def test_long_lines_with_few_common_words_are_not_compared_word_by_word(monkeypatch):
    rng, calls = np.random.default_rng(8), []
    plain = line_dedup.edit_alike
    monkeypatch.setattr(line_dedup, "edit_alike", lambda *x: calls.append(x) or plain(*x))
    base = rng.integers(0, 1 << 32, 300, np.uint32)
    lines = [base]
    for changed in (20, 59, 60, 61, 150, 300):
        lines.append(base.copy())
        lines[-1][rng.choice(300, changed, replace=False)] = rng.integers(0, 1 << 32, changed, np.uint32)
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :]] + [(base, base[::-1].copy())]
    assert line_dedup.edits_alike(*zip(*pairs, strict=True)).tolist() == [plain(a, b) for a, b in pairs]
    assert all(len(np.intersect1d(a, b)) >= 240 for a, b, _ in calls) and 4 <= len(calls) < len(pairs)


def test_keys_meet_a_part_at_a_time(monkeypatch):
    rng, sizes = np.random.default_rng(9), []
    rows = np.zeros(6000, line_dedup._KEY)
    for name, high in (("key", 900), ("n", 12), ("at", 6), ("name", 3000)):
        rows[name] = rng.integers(0, high, len(rows))
    wire, part = line_dedup.packed(rows), rows["key"] % 4
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(4, dtype=np.int32)), pa.array([wire[low : low + 3000][part[low : low + 3000] == k].tobytes() for k in range(4)], pa.binary())], names=["part", "rows"]) for low in (0, 3000)]
    want, plain = line_dedup.candidates(line_dedup.unpacked(wire), 80, 4), line_dedup.unpacked
    monkeypatch.setattr(line_dedup, "unpacked", lambda x: sizes.append(len(x)) or plain(x))
    found = list(line_dedup._met(80, 4)(iter(batches)))
    assert [np.stack([b.column(0), b.column(1)], 1).tolist() for b in found] == [x.tolist() for x in want]
    assert sum(sizes) == 6000 and max(sizes) < 2000


def test_vector_recall_holds_as_vectors_get_many(spark):
    rng = np.random.default_rng(6)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, 2500, 64)))
    b -= (a * b).sum(1)[:, None] * a
    near = 0.905 * a + np.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1)[:, None]
    near[700:] = rng.standard_normal((1800, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = embedding_dedup.embedding_groups(df, window=2).where("n_links > 0").count() / 1400  # as among 80,000 in windows of 32
    assert 0.99 <= got <= 1
    assert [embedding_dedup.passes_for(n, 0.9) for n in (10, 5_000, 50_000, 1_500_000)] == [16, 18, 33, 73]


def test_windows_reach_over_short_partitions(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(24)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_groups(df, passes=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert got == want and sum(want.values()) >= 20
    assert sorted(embedding_dedup._tails({0: 3, 2: 32, 5: 1, 6: 2}, 32)) == [(0, 1), (2, 4), (2, 5)]


def test_repeats_of_lines_with_few_words_go(spark):
    sentence = "这是一个没有空格的句子它在许多文档里重复出现"
    rows = [(1, f"All rights reserved\n{sentence}\nyes"), (2, f"ALL RIGHTS reserved.\n\n{sentence}\nyes\n--------------------"), (3, f"{sentence}\n{sentence}又\n--------------------\n{sentence}又\n日本語です")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nyes\n--------------------", 2), 3: (f"{sentence}又\n--------------------\n日本語です", 2)}
    for _, data, offsets in slabs(pa.array(["a b\n", "", "日本 x-y", None, "\n\nzz"])):
        assert line_dedup.Lines(data, offsets).letters.tolist() == [2, 0, 0, 4, 0, 0, 0, 2]


def test_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    docs = copies(9, [8, 20, 40], 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, 4, 85).collect()}
    assert got == plain_groups(docs, 4, 85)


def test_very_long_texts_and_clashing_columns(spark):
    rnd = random.Random(12)
    long = " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(3000)) for _ in range(30_000))
    rows = [(1, long, 5, "z"), (2, long.replace("a1 ", "b1 ", 3), 6, "y"), (3, "short text of five words", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped long, component_id string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_report(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = jaccard_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.component_id) for r in kept.collect()} == {(1, "z"), (3, "x")}
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == ["doc_id", "text", "component_id", "n_dropped"] and {r.doc_id: r.n_dropped for r in left.collect()} == {1: 0, 2: 1, 3: 0}
    assert sharding.shard_report(docs).count() == 3


def _keyed(lines: list[list[str]]) -> list[set[int]]:
    """The keys of each line, by the counts of all."""
    text = "\n".join(" ".join(x) for x in lines).encode()
    found = line_dedup.Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    pairs = line_dedup.word_pairs(found.hashed, found.counts)[0]
    words = np.bincount(line_dedup._bucket(found.hashed), minlength=line_dedup.BUCKETS)
    rare = line_dedup.rarity(words, np.bincount(line_dedup._pair_bucket(pairs), minlength=line_dedup.PAIRS * line_dedup.BUCKETS))
    line, key, _ = line_dedup.line_keys(found.hashed, found.counts, rare, 80)
    return [set(key[line == i].tolist()) for i in range(len(lines))]


def test_what_many_lines_quote_is_no_key_of_them():
    """Else all lines that quote it are one group, which is compared in tiles that move each line once a tile."""
    rnd = random.Random(14)
    quoted = [f"rare{i}" for i in range(12)]
    lines = [[*(f"w{rnd.randrange(300)}" for _ in range(14)), *quoted, *(f"w{rnd.randrange(300)}" for _ in range(14))] for _ in range(200)]
    keys = _keyed(lines)
    shared = [len(a & b) for i, a in enumerate(keys) for b in keys[:i]]
    assert sum(n > 0 for n in shared) < 0.05 * len(shared)
    assert all(len(k) == line_dedup.broken(np.array([40]), 80)[0] + 1 for k in keys)


def test_words_of_candidates_are_gone_before_texts_are_rewritten(spark):
    line = "this is a longer line whose words are all found again but for one"
    docs = spark.createDataFrame([(6, line), (7, line + " word"), (7, line + " words")], "doc_id long, text string")
    folder = Path(line_dedup.cut(docs)._jdf.sparkSession().sparkContext().getCheckpointDir().get().removeprefix("file:"))
    assert line_dedup.repeated_lines(docs).count() == 1 and not list(folder.glob("lines-*"))
