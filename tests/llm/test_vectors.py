"""Centroid clusters and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from weft.llm import hard_negatives as hn
from weft.llm.centroid_clusters import Bounds, cluster_vectors, moved
from weft.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, cluster string, score double"


def vectors(seed, n, dims, grid=64):
    rnd = random.Random(seed)
    middles = [[rnd.randint(-grid, grid) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        x = [(m + rnd.randint(-9, 9)) / 128 for m in rnd.choice(middles)]
        rows.append((i, rnd.choice([0, 1, 2]), x, "c", 0.5))
    rows += [(n + i, 1, rows[5][2], None, None) for i in range(30)]  # copies
    odd = [None, [], [None] * dims, [math.nan] * dims, [math.inf] * dims, [0.1] * (dims - 1), [3e38] * dims, [0.0] * dims]
    rows += [(n + 100 + i, None if i == 2 else 1, x, None, None) for i, x in enumerate(odd)]
    rnd.shuffle(rows)
    return rows


def whole(x, dims=None):
    if x is None or any(v is None or not math.isfinite(v) for v in x) or (dims is not None and len(x) != dims):
        return None
    q = [math.floor(256 * float(np.float32(v))) for v in x]
    return None if any(abs(v) > 1 << 27 for v in q) else q


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, q) for i, _, x, *_ in rows if (q := whole(x, dims)) is not None]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [q for _, q in start]

    def assign():
        return [min(((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))) for _, q in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (_, c) in zip(kept, near, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    inertia = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, near, strict=True))


@pytest.mark.parametrize(("n", "k", "dims", "grid"), [(200, 12, 6, 64), (60, 40, 3, 1), (30, 50, 4, 8), (0, 5, 4, 8)])
def test_clusters_equal_plain(spark, n, k, dims, grid):
    rows = vectors(n + k, n, dims, grid) if n else []
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), k, 3, dims)
    assert sorted(map(tuple, got.collect())) == plain_clusters(rows, k, 3, dims)


def test_repeated_and_null_ids_count_each(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (1, [0.9, 0.9]), (None, [0.5, 0.5])]
    got = cluster_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 2, 2, 2).collect()
    assert len(got) == 4 and sorted(r["vec_id"] or 0 for r in got) == [0, 1, 1, 1]


def test_bounds_skip_and_change_nothing():
    rnd = np.random.default_rng(1)
    q = np.concatenate([rnd.integers(-20, 20, (300, 8)) + 200 * m for m in range(5)])
    at = q[rnd.permutation(len(q))[:10]]
    cluster, upper, lower, all_ = Bounds(at, None).first(q)
    measured = 0
    for _ in range(6):
        sums = np.stack([np.r_[(cluster == j).sum(), q[cluster == j].sum(0)] for j in range(10)])
        at, before = moved(at, sums), at
        cluster, upper, lower, n = Bounds(at, before).again(q, cluster, upper, lower)
        measured += n
        d = ((q[:, None] - at[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper**2 >= d[np.arange(len(q)), cluster]).all() and (lower.astype(float) ** 2 <= d).all()
    assert measured < 6 * all_ / 2


def plain_negatives(rows):
    kept = {}
    for i, label, x, *_ in rows:
        if i is not None and label is not None and (q := whole(x)) is not None:
            mine = (label, len(q), np.array(q, np.int32).tobytes(), q)
            kept[i] = min(kept.get(i, mine), mine)
    kept = {i: ((label + 1) % 10 if i % 7 == 0 else label, q) for i, (label, _, _, q) in kept.items()}
    out = []
    for a, (mine, q) in kept.items():
        if a % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, label) for i, (label, r) in kept.items() if i != a and len(r) == len(q))
            for s, p, _ in [x for x in scored if x[2] == mine][:5]:
                fits = [x for x in scored if x[2] != mine and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("n", "lists", "first", "part", "chunk"), [(1100, 12, 50, 64, 4), (700, 1, 2048, 1024, 512), (500, 40, 10, 7, 2), (0, 3, 5, 5, 5)])
def test_negatives_equal_plain(spark, monkeypatch, n, lists, first, part, chunk):
    for name, value in (("FIRST", first), ("PART", part), ("CHUNK", chunk)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(n, n, 6) if n else []
    rows += [(100, 2, [0.5] * 6, None, None), (100, 1, [0.25] * 6, None, None), (300, 1, [0.2] * 5, None, None), (301, 1, [0.3] * 5, None, None), (302, 2, [0.25] * 5, None, None)] if n else []
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), lists=lists)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_ranges_hold_and_leave_lists_out():
    rnd = np.random.default_rng(2)
    members = [rnd.integers(-30, 30, (50, 8)) + 300 * rnd.integers(-1, 2, 8) for _ in range(6)]
    middles = np.stack([m.mean(0) for m in members])
    radius = np.array([np.sqrt(((m - c) ** 2).sum(1)).max() * (1 + 1e-9) for m, c in zip(members, middles, strict=True)])
    index = hn.Index(middles, np.r_[radius, np.zeros(hn.OTHERS)], np.r_[np.full(6, 50), np.zeros(hn.OTHERS, int)], np.zeros(7 + hn.OTHERS, int))
    low, high = index.ranges(members[0][0])
    scores = [m @ members[0][0] for m in members]
    assert all(low[i] <= s.min() and s.max() <= high[i] for i, s in enumerate(scores))
    kth = int(np.sort(scores[0])[-5])
    visited = hn.visited(low, high, index.members, hn._LEAST, hn._MOST, kth, False)
    assert set(np.flatnonzero([s.max() >= kth for s in scores])) <= {*visited, *hn.visited(low, high, index.members, hn._LEAST, hn._MOST, None, True)}
