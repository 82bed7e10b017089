"""Repeated passages against all windows in plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from weft.llm import substring_dedup as sd
from weft.llm._words import slabs, words


def plain(rows, window):
    seen, out = set(), []
    for i, t in rows:
        found = (t or "").encode().split()
        gone = set()
        for p in range(len(found) - window + 1):
            x = tuple(found[p : p + window])
            if x in seen:
                gone.update(range(p, p + window))
            seen.add(x)
        kept = b" ".join(x for j, x in enumerate(found) if j not in gone)
        out.append((i, len(found), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 30, 500]))]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 90))] for _ in range(6)]
    out = []
    for _ in range(n):
        found = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.4:
                some = rnd.choice(passages)
                at = rnd.randrange(len(some))
                found += some[at : rnd.randint(at, len(some))] if kind < 0.2 else some
            elif kind < 0.5:
                found += [rnd.choice(vocabulary)] * rnd.randint(1, 60)
            elif kind < 0.6:
                found += (rnd.sample(vocabulary, min(3, len(vocabulary))) * 30)[: rnd.randint(1, 80)]
            else:
                found += [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 50))]
        out.append(None if rnd.random() < 0.03 else rnd.choice([" ", "\n", "  \t"]).join(found))
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 2), (3, 5), (4, 20), (5, 20), (8, 33), (14, 20)])
def test_report_equals_all_windows(spark, seed, window):
    rows = [(7 * i + seed, t) for i, t in enumerate(texts(seed, 20))]
    shuffled = random.Random(seed).sample(rows, len(rows))
    got = sd.passage_report(spark.createDataFrame(shuffled, "doc_id bigint, text string").repartition(3), window)
    assert sorted(map(tuple, got.collect())) == plain(rows, window)


@pytest.mark.parametrize(("common", "room", "held"), [(1, 2_000_000, 250_000), (2, 30, 60), (64, 4, 10), (0, 1, 1)])
def test_common_names_and_crowded_parts_change_nothing(spark, monkeypatch, common, room, held):
    for name, value in (("COMMON", common), ("ROOM", room), ("HELD", held)):
        monkeypatch.setattr(sd, name, value)
    rows = [(i, t) for seed in (5, 4) for i, t in enumerate(texts(seed, 14), 100 * seed)]
    rows += [(1000 + i, f"{'same words at the start of each text of many that go on in their own way here'} {' '.join(f'r{i}x{j}' for j in range(25))}") for i in range(12)]
    got = sd.passage_report(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id bigint, text string").repartition(3), 12)
    assert sorted(map(tuple, got.collect())) == plain(sorted(rows), 12)


def test_texts_keep_columns_and_spacing(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(2, f"A  b\n{long}", "n", 1), (1, long, "m", 2), (3, "a  b\tc", None, 3), (4, None, "o", 4), (5, "", "p", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place string, start int")
    got = {r["doc_id"]: r for r in sd.drop_repeated_passages(docs).collect()}
    assert got[2]["text"] == "A b" and got[2]["n_removed"] == 40 and got[2]["place"] == "n"
    assert got[1]["text"] == long and got[3]["text"] == "a  b\tc" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[3]["start"] == 3 and sd.drop_repeated_passages(docs).columns == [*docs.columns, "n_removed"]


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(1, long), (1, long), (None, long), (None, f"{long} y"), (2, "z")]
    got = sd.passage_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in got) == [(1, 0), (1, 30), (2, 0), (9, 30), (9, 30)]


def test_empty_table_and_bad_window(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.passage_report(docs).collect() == []
    with pytest.raises(ValueError, match="words"):
        sd.passage_report(docs, 1)


def test_equal_windows_have_equal_anchors():
    for seed in range(40):
        column = [t or "" for t in texts(seed, 15)]
        import pyarrow as pa

        (_, data, offsets), = slabs(pa.array(column))
        begin, _, hashed = words(data, offsets, lower=False)
        counts = np.diff(np.searchsorted(begin, offsets))
        text = np.repeat(np.arange(len(counts)), counts)
        at, start, size, name = sd.anchors(hashed, text, 20)
        first = {}
        for p, s, n, x in zip(at.tolist(), start.tolist(), size.tolist(), name.tolist(), strict=True):
            assert first.setdefault(hashed[p : p + 20].tobytes(), (s - p, n, x)) == (s - p, n, x)
            assert p <= s and s + n <= p + 20
        assert len(at) == np.maximum(0, counts - 19).sum()


def test_segments_survive_packing():
    rnd = np.random.default_rng(0)
    rows = np.zeros(50, sd._SEGMENT)
    for c, top in (("name", 1 << 40), ("words", 1 << 63), ("before", 1 << 24), ("after", 1 << 24), ("place", 1 << 50), ("start", 1 << 20), ("windows", 20)):
        rows[c] = rnd.integers(0, top, 50)
    rows = rows[np.argsort(rows["place"])]
    assert (sd.unpack(sd.pack(rows)) == rows).all() and (sd.unpack(sd.pack(rows[:1])) == rows[:1]).all()
